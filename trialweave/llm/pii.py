"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

All work on texts is DataFrame expressions. A generator is a regular expression; its matches (leftmost, not overlapping) and
what stands between them give the spans' places, by sums of blocks of lengths, so that time grows with the text. Base rules (email, ip, card,
phone) accept their generator's valid matches outright. The other generators' matches (other forms of these, and secrets: long runs of letters and
digits), and base matches that fail, are candidates; the trees score them by format and context. Candidates that overlap a base span or a better candidate are left out.

The trees learn from all matches of the corpus: valid base matches are personal data, and candidates are labelled by whether
a word that announces the kind stands before them. That word is no feature: the trees learn which formats and surroundings are mostly announced, and so
judge those that aren't. A fifth of the matches, by a hash of place and features, is held out to calibrate the scores and to set the least probability of
each kind for a redaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .common import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
#: The share of announced candidates that a kind's threshold must reach on the held-out fifth, and how many candidates must show it; characters of
#: context, which ends at the generator's last match.
PRECISION, SHOWN, CONTEXT = 0.9, 10, 40
#: Lengths that are added up to one of the next level, where places are made of them.
BLOCK = 64
# Java repeats groups by recursion unless the repetition is possessive; nothing after them could take a character back, so
# possessive ones match alike. A look-behind (or the end of the last match) keeps long runs from being tried at each place.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # runs of digits with single separators are matched whole; only those of 14 to 19 digits can be valid. The same goes for 10 to 15 digits of a phone.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9,14}+(?![\x20().-]*+[0-9])",
}
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{20,}+={0,2}+(?![A-Za-z0-9_=-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])",
}
#: Words that announce a kind.
CUES = {
    "email": r"e-?mail|mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|dirección",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta",
    "secret": r"token|secret|passw|passwd|pwd|\bkey|api.?key|credential|bearer|clave|contraseña|passwort|schlüssel|jeton|mot de passe",
    "phone": r"phone|call|tel|mobile|cell|fax|telefon|téléphone|teléfono|anruf",
}
#: A text without these characters has no match of any generator.
ANY = r"[0-9@:]|\b(?i:at)\b"
FEATURES = ("kind", "characters", "digits", "letters", "separators", "groups", "plus", "luhn", "octets", "marked", "glued_before", "glued_after", "quoted", "hexadecimal", "capitals")


def located(text: str, pattern: str) -> Column:
    """array<struct<begin, value, before, after>> of the pattern's matches in the column `text`: the place in code points, the match, what stands
    before it up to the last match, at most CONTEXT characters of it, and the character after it.

    A place is the sum of the lengths before it, of whole blocks, of blocks in the last one of these, and of single lengths.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    total = lambda of, start, n: f"aggregate(slice({of}, {start}, {n}), 0L, (a, x) -> a + x)"
    blocks = lambda of: f"transform(sequence(0, greatest(size({of}) - 1, 0) div {BLOCK}), k -> {total(of, f'k * {BLOCK} + 1', BLOCK)})"
    let = lambda value, name, then: f"transform(array({value}), {name} -> {then})[0]"
    place = f"{total('b.large', 1, f'cast(i div {BLOCK * BLOCK} as int)')} + {total('b.small', f'cast(i div {BLOCK * BLOCK} as int) * {BLOCK} + 1', f'cast(i div {BLOCK} as int) % {BLOCK}')}"
    place += f" + {total('z.w', f'cast(i div {BLOCK} as int) * {BLOCK} + 1', f'i % {BLOCK}')} + length(y.p[i])"
    rows = f"transform(y.m, (v, i) -> named_struct('begin', {place}, 'value', v, 'before', right(y.p[i], {CONTEXT}), 'after', left(y.p[i + 1], 1)))"
    large = let(f"named_struct('small', s, 'large', {blocks('s')})", "b", rows)
    small = let(blocks("z.w"), "s", large)
    widths = let("named_struct('w', transform(y.m, (v, i) -> cast(length(y.p[i]) + length(v) as bigint)))", "z", small)
    return F.expr(let(f"named_struct('m', regexp_extract_all({text}, '{quoted}', 0), 'p', split({text}, '{quoted}', -1))", "y", f"if(size(y.m) = 0, null, {widths})"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)


def _luhn_card(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when((n >= 14) & (n <= 19), luhn(_digits(value))).otherwise(False)


def valid(kind: str, value: Column) -> Column:
    """The base rule of a kind for a match of its pattern."""
    n = F.length(_digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": _luhn_card(value), "phone": (n >= 10) & (n <= 15)}[kind]


def _span(kind: str, base: bool):
    k = KINDS.index(kind)
    return lambda x: F.struct(
        x["begin"].alias("begin"), F.lit(k).alias("kind"), (x["begin"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.lit(base).alias("base"),
        (valid(kind, x["value"]) if base else F.lit(False)).alias("valid"), F.lower(x["before"]).alias("before"), x["after"].alias("after"))


_SPANS = "array<struct<begin:bigint,kind:int,end:bigint,value:string,base:boolean,valid:boolean,before:string,after:string>>"


def matches(docs: DataFrame) -> DataFrame:
    """`docs` with `whole` (the text; null counts as empty) and `found`: the matches of all generators, each with its kind, place,
    whether it is of a base pattern, whether it is valid there, whether a word announces it (`cue`), and its features."""
    docs = docs.withColumn("whole", F.coalesce("text", F.lit(""))).withColumn("some", F.col("whole").rlike(ANY))
    needs = {"email": F.col("some") & F.col("whole").contains("@"), "phone": F.col("some") & F.col("whole").contains("+")}
    names = []
    for group, patterns in (("base", BASE), ("more", MORE)):
        for kind, pattern in patterns.items():
            need = needs.get(kind, F.col("some")) if group == "base" else F.col("some")
            docs = docs.withColumn(f"_{group}_{kind}", F.when(need, located("whole", pattern)))
            names.append((group, kind))
    found = [F.transform(F.col(f"_{group}_{kind}"), _span(kind, group == "base")) for group, kind in names]
    empty = F.array().cast(_SPANS)
    docs = docs.withColumn("found", F.when(F.col("some"), F.concat(*[F.coalesce(f, empty) for f in found])).otherwise(empty)).drop("some", *[f"_{g}_{k}" for g, k in names])
    kept = [*"begin kind end base valid".split()]
    return docs.withColumn("found", F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in kept], _cue(x).alias("cue"), _features(x).alias("f"))))


def _cue(x: Column) -> Column:
    cue = F.lit(False)
    for k, kind in enumerate(KINDS):
        cue = F.when(x["kind"] == k, x["before"].rlike(CUES[kind])).otherwise(cue)
    return cue


def _features(x: Column) -> Column:
    """array<double> of FEATURES for a match."""
    value = x["value"]
    count = lambda p: F.length(F.regexp_replace(value, p, ""))
    own = [
        x["kind"], F.length(value), F.length(_digits(value)), count("[^A-Za-z]"), count(r"[A-Za-z0-9]"), F.size(F.split(value, "[^0-9A-Za-z]+")),
        value.startswith("+"), _luhn_card(value), F.when(x["kind"] == 1, _octets(value)).otherwise(False),
        x["before"].rlike(r"[:=#(<\[]\s*[\"'`]?$"), x["before"].rlike("[0-9a-z]$"), x["after"].rlike("[0-9A-Za-z]"),
        x["before"].rlike(r"[\"'`]$"), value.rlike("^[0-9A-Fa-f]+$"), count("[^A-Z]"),
    ]
    return F.array(*[F.coalesce(f.cast("int").cast("double"), F.lit(0.0)) for f in own])


def fit(found: DataFrame, precision: float = PRECISION, shown: int = SHOWN, local: int = boosting.LOCAL_ROWS) -> dict | None:
    """The trees and each kind's threshold, of the column `found` of matches(); None if all matches are of one class, when the base rules decide alone.

    The matches of all documents are counted by their features, and trees, calibration and thresholds are made of all these counts, by Spark jobs if there
    are more than `local` of them. A kind of which fewer than `shown` held-out candidates reach the precision is never redacted beyond the base.
    """
    rows = found.where(F.size("found") > 0).select(F.explode("found").alias("x")).select(
        F.col("x.f").alias("features"), F.col("x.valid").alias("valid"), (F.pmod(F.xxhash64("x"), F.lit(5)) == 0).alias("aside"), (F.col("x.valid") | F.col("x.cue")).cast("long").alias("y"))
    counted = materialize(rows.groupBy("features", "valid", "aside").agg(F.count("*").alias("n"), F.sum("y").alias("positive")), "counted")
    number = {r.aside: r for r in counted.groupBy("aside").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).collect()}
    if len(number) < 2 or not 0 < number[False].positive < number[False].n:
        return None
    model = boosting.fit(counted.where("not aside"), local=local)
    feature = lambda f: F.get("features", F.lit(f))
    held = counted.where("aside").select(feature(FEATURES.index("kind")).cast("int").alias("kind"), "valid", boosting.margin_column(model, feature).alias("z"), "n", "positive")
    held = materialize(held.groupBy("kind", "valid", "z").agg(*[F.sum(c).alias(c) for c in ("n", "positive")]), "held")
    a, b = boosting.calibrate(held, local)
    p = 1 / (1 + F.exp(-(F.lit(a) * F.col("z") + F.lit(b))))
    candidates = held.where("not valid").groupBy("kind", p.alias("p")).agg(*[F.sum(c).alias(c) for c in ("n", "positive")])  # candidates of one probability stand or fall together
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    above = candidates.select("kind", "p", *[F.sum(c).over(down).alias(c) for c in ("n", "positive")])
    good = above.where((F.col("positive") / F.col("n") >= precision) & (F.col("n") >= shown)).groupBy("kind").agg(F.min("p").alias("p"))
    least = {r.kind: r.p - 1e-9 for r in good.collect()}
    return {"trees": model, "slope": a, "offset": b, "least": [least.get(k, 2.0) for k in range(len(KINDS))]}


def _below(items: Column, field: str, bound: Column, inclusive: bool) -> Column:
    """How many of the structs, sorted by `field`, lie below the bound, found by halving."""
    def step(at, _):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        value = F.get(items, mid)[field]
        low = value <= bound if inclusive else value < bound
        return F.when(at["lo"] >= at["hi"], at).when(low, F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    steps = F.length(F.bin(F.size(items)))  # enough to halve the list until one place is left
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi")), step, lambda at: at["lo"])


def _overlapping(items: Column, x: Column) -> Column:
    """Those of the structs (in order, none over another) that overlap x."""
    first, end = _below(items, "end", x["begin"], True), _below(items, "begin", x["end"], False)
    return F.slice(items, first + 1, F.greatest(end - first, F.lit(0)))


def select(found: DataFrame, model: dict | None) -> DataFrame:
    """Rows of matches() with `base` and `spans` in place of `found`.

    A generator's matches don't overlap, so those that overlap a candidate are found by halving, list by list.
    """
    plain = lambda x, score: F.struct(x["begin"].alias("begin"), x["kind"].alias("kind"), x["end"].alias("end"), score.alias("score"))
    rows = found.withColumn("base", F.array_sort(F.transform(F.filter("found", lambda x: x["valid"]), lambda x: plain(x, F.lit(1.0)))))
    if model is None or min(model["least"]) > 1:
        return rows.withColumn("spans", F.col("base")).drop("found")
    p = lambda x: 1 / (1 + F.exp(-(F.lit(model["slope"]) * boosting.margin_column(model["trees"], lambda f: F.get(x["f"], F.lit(f))) + F.lit(model["offset"]))))
    kinds = range(len(KINDS))

    def candidates(k: int, base: bool) -> Column:
        scored = F.transform(F.filter("found", lambda x: ~x["valid"] & (x["kind"] == k) & (x["base"] == base)), lambda x: plain(x, p(x)))
        return F.filter(scored, lambda x: x["score"] >= model["least"][k])

    of_kind = lambda k: F.filter("base", lambda b: b["kind"] == k)
    own = [(f"_base_{k}", of_kind(k)) for k in range(len(BASE))]
    own += [(f"_{'failed' if base else 'more'}_{k}", candidates(k, base)) for k in kinds if model["least"][k] <= 1 for base in ((True, False) if KINDS[k] in BASE else (False,))]
    rows = rows.withColumns(dict(own))
    lists = [name for name, _ in own if not name.startswith("_base_")]
    free = lambda x: ~F.greatest(*[F.size(_overlapping(F.col(f"_base_{k}"), x)) > 0 for k in range(len(BASE))])
    rows = rows.withColumns({name: F.filter(name, free) for name in lists})
    better = lambda a, b: F.struct(a["score"], -a["begin"], -a["end"], a["kind"]) > F.struct(b["score"], -b["begin"], -b["end"], b["kind"])
    best = lambda x: ~F.greatest(F.lit(False), *[F.exists(_overlapping(F.col(name), x), lambda o: better(o, x)) for name in lists])
    added = F.filter(F.concat(*lists), best)
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.array_distinct(added)))).drop("found", *[name for name, _ in own])


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, whole (the text), base and spans.

    Both are arrays of struct<begin, kind, end, score> sorted by begin, then kind (its place in KINDS), then end, in code points, end
    exclusive; `spans` has the base spans, of score 1, and the redactions that the trees add. Null counts as empty. Rows are
    independent: repeated ids or texts and other columns don't matter; an empty table gives no rows.
    """
    return select(matches(docs.select("doc_id", "text")), model).select("doc_id", "whole", "base", "spans")


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text of find()'s rows, with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["begin"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring("whole", (acc["at"] + 1).cast("int"), (x["begin"] - acc["at"]).cast("int")), F.get(name, x["kind"])).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring("whole", (acc["at"] + 1).cast("int"), F.length("whole"))))
    return found.select("doc_id", done.alias("text"))


def listed(spans: str) -> Column:
    """kind:begin:end of the spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(":"), x["begin"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
