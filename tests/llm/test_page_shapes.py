"""Main text of pages of common shapes in several languages: no name, element or list of words may empty a page."""

import itertools

import pytest

from trialweave.llm import html_text

#: Three paragraphs a language, the last one short.
TEXTS = {
    "en": ("All human beings are born free and equal in dignity and rights, and they should act towards one another in a spirit of brotherhood, whatever they have been told before.", "Everyone is entitled to all the rights that are set out here, without distinction of any kind, such as the colour of the skin, the language, the religion or any other status, and it is not for others to decide.", "That is what we had in mind."),
    "de": ("Alle Menschen sind frei und gleich an Würde und Rechten geboren, sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen, was auch immer war.", "Jeder hat Anspruch auf die Rechte, die in dieser Erklärung verkündet sind, ohne irgendeinen Unterschied, etwa nach der Farbe, der Sprache, der Religion oder nach einem sonstigen Stand, und das ist auch gut.", "Das ist es, was wir wollten."),
    "fr": ("Tous les êtres humains naissent libres et égaux en dignité et en droits, ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.", "Chacun peut se prévaloir de tous les droits et de toutes les libertés qui sont dans la déclaration, sans distinction aucune, que ce soit par la couleur, la langue ou la religion, et c'est ainsi que nous le voulons.", "C'est ce que nous avons dit."),
    "es": ("Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y de conciencia, deben comportarse los unos con los otros en un espíritu de hermandad.", "Toda persona tiene los derechos que se dan en esta declaración, sin distinción por el color, el idioma, la religión o por otra condición, y no es de otros lo que se haga con ellos en la vida.", "Es lo que se dijo en la casa."),
    "pl": ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa, bez względu na pochodzenie.", "Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości czy majątku.", "Tak właśnie chcieliśmy."),
    "ru": ("Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства, что бы ни говорили раньше другие.", "Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей декларацией, без какого бы то ни было различия, как то в отношении расы, цвета кожи, пола, языка или религии.", "Именно этого мы и хотели."),
    "zh": ("人人生而自由,在尊严和权利上一律平等,他们赋有理性和良心,并应以兄弟关系的精神相对待,无论过去别人说过什么,也无论将来会发生什么,这一点对所有的人都是一样的。", "人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解、国籍或社会出身、财产、出生或其他身份等任何区别,而且不得因为任何理由加以限制。", "这就是我们想要的。"),
}
MENU = "<ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate("Home News Sport Weather Shop Contact".split())) + "</ul>"
CARDS = "".join(f'<div class="card"><a href="/{k}">Read about number {k} of these stories of today</a></div>' for k in range(4))


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


#: Shapes: their html by the paragraphs, and a foreign text for adverts and comments. What isn't of the paragraphs is no main text.
SHAPES = {
    "blogger": lambda t, x: f'<div class="header section">{MENU}</div><div class="widget Blog" id="Blog1"><div class="blog-posts hfeed"><div class="post-body entry-content">{paragraphs(t)}</div></div></div><div class="widget BlogArchive">{MENU}</div><footer>{x}</footer>',
    "aspnet": lambda t, x: f'<form method="post" action="./" id="aspnetForm"><div class="menu">{MENU}</div><div id="ctl00_Main">{paragraphs(t)}</div><div id="footer">{x}</div></form>',
    "aspnet with an article": lambda t, x: f'<form id="form1"><nav>{MENU}</nav><article>{paragraphs(t)}</article><aside><p>{x}</p></aside></form>',
    "wordpress": lambda t, x: f'<header class="site-header">{MENU}</header><div id="content" class="site-content"><article class="post-12 post type-post hentry"><div class="entry-content">{paragraphs(t)}</div></article><div id="comments" class="comments-area"><ol><li><article class="comment-body"><p>{x}</p></article></li></ol></div></div><aside class="widget-area">{CARDS}</aside>',
    "layout class on the outer box": lambda t, x: f'<div id="page-wrapper" class="sidebar-right"><div class="menu">{MENU}</div><div class="column">{paragraphs(t)}</div></div><div class="footer">{x}</div>',
    "main in a named box": lambda t, x: f'<div class="layout sidebar"><nav>{MENU}</nav><main>{paragraphs(t)}</main></div><div class="cookie-notice">{x}</div>',
    "fieldset": lambda t, x: f"<fieldset>{paragraphs(t)}</fieldset><nav>{MENU}</nav>",
    "old tables": lambda t, x: f"<table><tr><td>{MENU}</td><td>{''.join(f'<div>{p}</div>' for p in t)}</td></tr></table>",
    "documentation": lambda t, x: f'<div class="sidebar"><div class="toctree">{MENU}</div></div><div class="document"><div role="main">{paragraphs(t)}<pre>x = f(1)</pre></div></div><div class="footer">{x}</div>',
    "news": lambda t, x: f'<div id="masthead">{MENU}</div><div class="ad">{x}</div><div class="story">{paragraphs(t)}<div class="related">{CARDS}</div></div><div id="newsletter">{x}</div>',
    "wiki": lambda t, x: f'<div id="mw-navigation">{MENU}</div><div id="content" class="mw-body"><div id="mw-content-text">{paragraphs(t)}<div class="navbox">{MENU}</div></div></div><div id="footer">{x}</div>',
    "plain": lambda t, x: f"<h4></h4>{paragraphs(t)}",
    "header around the lead": lambda t, x: f"<article><p>{t[0]}</p>{paragraphs(t[1:])}</article><footer>{x}</footer>",
    "more at the end": lambda t, x: f'<article><p>{t[0]}</p><div class="more"><p>{t[1]}</p></div><p>{t[2]}</p></article><div class="sponsored">{x}</div>',
    "two columns": lambda t, x: f'<div class="content"><p>{t[0]}</p></div><div><p>{t[1]}</p></div><div class="newsletter-signup">{x}</div>',
}


def lines(shape, texts):
    return [*texts[:2], *(() if shape == "two columns" else texts[2:]), *(["x = f(1)"] if shape == "documentation" else [])]


@pytest.mark.parametrize("shape", SHAPES)
def test_no_shape_is_emptied(shape):
    for lang, other in itertools.product(TEXTS, ("en", "pl")):
        page = f"<html><head><title>t</title></head><body>{SHAPES[shape](TEXTS[lang], TEXTS[other][1])}</body></html>"
        got = html_text.main_text(page).split("\n")
        assert set(TEXTS[lang][:2]) <= set(got), (lang, other)


def test_blocks_of_all_shapes():
    right = found = wanted = 0
    for shape, lang in itertools.product(SHAPES, TEXTS):
        page = f"<html><body>{SHAPES[shape](TEXTS[lang], TEXTS['de' if lang != 'de' else 'en'][1])}</body></html>"
        got, want = html_text.main_text(page).split("\n"), lines(shape, TEXTS[lang])
        right += len(set(got) & set(want))
        found += len(got)
        wanted += len(want)
    assert right / found >= 0.95 and right / wanted >= 0.95, (right, found, wanted)


def test_remarks_longer_than_the_article_stay_out():
    for lang in TEXTS:
        page = f'<div><p>{TEXTS[lang][0]}</p></div><div id="comments">{paragraphs(TEXTS[lang][1:2] * 5)}</div>'
        assert html_text.main_text(page) == TEXTS[lang][0], lang
