"""Toxicity: Levenshtein automata intersected with a lexicon's trie, and a window around each find.

The lexicon is learnt: words and stems (word beginnings) that occur in toxic training documents, in several contexts, and hardly elsewhere. The
trie of its terms and the Levenshtein automaton (insertions, deletions, substitutions and swaps, as many as a term's
length allows) are walked together: a state is the set of (trie node, errors) a prefix can reach, made when first met. A find
is weighed by its window: quotation marks and words of reporting make it a mention, address and further finds make it
abuse. A logistic model of the document's sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, materialize

#: The most distinct labelled training texts of either class (bounded, hash-ordered samples); tokens on either side of a find.
SAMPLE_TOXIC, SAMPLE_CLEAN, WINDOW = 1500, 4000, 8
#: Rules for a term: contexts it needs (at least, as a share of the toxic documents, and for each of its own documents, as copies of a
#: passage repeat theirs), share of its documents that are toxic, lengths of stems, words a stem needs.
CONTEXTS, CONTEXT_SHARE, VARIETY, PURITY, STEM_CHARS, STEM_WORDS = 5, 0.012, 0.5, 0.97, range(4, 9), 4
#: What a misspelt find counts; the share of clean documents in which a term's misspellings may be found.
MISSPELT, STRAY = 0.8, 0.0005
#: Words that a task remembers.
CACHED_WORDS = 1 << 17
TOKENS = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
#: Words of reporting and of address.
REPORTING = frozenset("said says say wrote writes called quote quoted quotes according term word slur sagte schrieb nannte wort zitat dit écrit mot cite dijo escribió palabra cita".split())
ADDRESS = frozenset("you your yours u ur du dich dir dein ihr tu te toi ton votre vous usted ustedes tus vosotros".split())


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1


class Lexicon:
    """Terms and stems, `strict` ones without errors; `find` gives the least errors with which a word is a term or begins with a stem, None if none does."""

    def __init__(self, terms: list[str], stems: list[str], strict: frozenset[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, int]] = [(-1, -1)]  # errors allowed at a term's, a stem's end
        for stem, names in ((0, terms), (1, stems)):
            for name in names:
                node = 0
                for c in name:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.ends.append((-1, -1))
                    node = self.next[node][c]
                end = list(self.ends[node])
                end[stem] = max(end[stem], 0 if name in strict else allowed_errors(name))
                self.ends[node] = tuple(end)
        self.most = [0] * len(self.next)
        for node in reversed(range(len(self.next))):  # children have larger numbers
            self.most[node] = max([*self.ends[node], *(self.most[x] for x in self.next[node].values())])
        self.states: dict[frozenset, int] = {}
        self.info: list[tuple[dict[str, int], int | None, int | None]] = []
        self.sets: list[frozenset] = []
        self.start = self._state({(0, 0, "")})
        self.words: dict[str, int | None] = {}

    def _state(self, reached: set) -> int:
        todo, closed = list(reached), set()
        while todo:  # a deletion moves on in the trie without a character
            node, e, swap = item = todo.pop()
            if item in closed or e > self.most[node]:
                continue
            closed.add(item)
            if not swap:
                todo += [(x, e + 1, "") for x in self.next[node].values()]
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.info)
            plain = [(node, e) for node, e, swap in key if not swap]
            word = min((e for node, e in plain if e <= self.ends[node][0]), default=None)
            stem = min((e for node, e in plain if e <= self.ends[node][1]), default=None)
            self.info.append(({}, word, stem))
            self.sets.append(key)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached = set()
        for node, e, swap in self.sets[state]:
            if swap:
                if c == swap:
                    reached.add((node, e, ""))
                continue
            for a, x in self.next[node].items():
                reached.add((x, e + (a != c), ""))
                if a != c and c in self.next[x]:
                    reached.add((self.next[x][c], e + 1, a))
            reached.add((node, e + 1, ""))
        found = self._state(reached)
        self.info[state][0][c] = found
        return found

    def find(self, word: str) -> int | None:
        if word in self.words:
            return self.words[word]
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        if len(self.info) > 50_000:  # states are made as words need them; forget them now and then
            self.states, self.info, self.sets = {}, [], []
            self.start = self._state({(0, 0, "")})
        state, best = self.start, None
        for c in word:
            ways, _, _ = self.info[state]
            state = ways[c] if c in ways else self._step(state, c)
            if not self.sets[state]:
                break
            stem = self.info[state][2]
            if stem is not None and (best is None or stem < best):
                best = stem
                if not best:
                    break
        else:
            end = self.info[state][1]
            best = end if best is None or end is not None and end < best else best
        self.words[word] = best
        return best


def doc_features(lexicon: Lexicon, text: str | None) -> list[float]:
    """Of the finds of a text: their abuse, whether it is more than one find's, mentions, the densest window, the share of words.

    A misspelt find counts for MISSPELT of an exact one.
    """
    words = tokens(text)
    find = lexicon.find
    hits = [(i, e) for i, w in enumerate(words) if (e := find(w)) is not None]
    if not hits:
        return [0.0] * 5
    quoted_before = np.cumsum([w in QUOTES for w in words])
    total = mention = densest = 0.0
    at = [i for i, _ in hits]
    low = 0
    for k, (i, e) in enumerate(hits):
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        while at[low] < i - WINDOW:
            low += 1
        near = k - low + 1
        quotation = 0.6 * (quoted_before[i] % 2 == 1 and quoted_before[-1] > quoted_before[i]) + 0.3 * (not REPORTING.isdisjoint(around))
        abuse = 1.0 + 0.5 * (not ADDRESS.isdisjoint(around)) + 0.25 * (near - 1)
        total, mention = total + abuse * (1.0 - quotation) * (MISSPELT if e else 1.0), mention + quotation
        densest = max(densest, near)
    return [math.log1p(total), float(total >= 1.5), math.log1p(mention), math.log1p(densest), math.log1p(100 * len(hits) / len(words))]


def learn_lexicon(texts: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """(terms, stems) of labelled texts. A document counts once a word; contexts are pairs of neighbouring words."""
    toxic, clean = Counter(), Counter()
    # copies of a text count once
    unique = {(" ".join((w := tokens(t))), y): w for t, y in texts}
    for (_, y), words in unique.items():
        own = set(words) - QUOTES
        (toxic if y else clean).update({*own, *((w[:n], "") for w in own for n in STEM_CHARS if len(w) > n)})
    pure = {t for t, n in toxic.items() if n >= CONTEXTS and n >= PURITY * (n + clean[t])}
    contexts, completions = defaultdict(set), defaultdict(set)
    for (_, y), words in unique.items():
        if y:
            for a, w, b in zip(["", *words], words, [*words[1:], ""]):
                for t in (w, *((w[:n], "") for n in STEM_CHARS if len(w) > n)):
                    if t in pure:
                        contexts[t].add((a, b))
                        completions[t].add(w)
    n_toxic = sum(y for _, y in unique)
    sure = {t for t in pure if len(contexts[t]) >= max(CONTEXTS, CONTEXT_SHARE * n_toxic, VARIETY * toxic[t])}
    grown = [t for t in sure if isinstance(t, tuple) and len(completions[t]) >= STEM_WORDS]
    # of nested stems with nearly the same finds the longest says most
    stems = [p for p, _ in grown if not any(len(q) > len(p) and q.startswith(p) and len(contexts[q, ""]) >= 0.9 * len(contexts[p, ""]) for q, _ in grown)]
    stems = [p for p in stems if not any(q != p and p.startswith(q) for q in stems)]
    terms = [t for t in sure if isinstance(t, str) and not any(t.startswith(p) for p in stems)]
    return sorted(terms), sorted(stems)


def learn_strict(terms: list[str], stems: list[str], texts: list[tuple[str, int]]) -> frozenset[str]:
    """Those whose misspellings are clean documents' words, of which more than the share STRAY of these documents has one."""
    clean = [set(tokens(t)) for t, y in texts if not y]
    seen = Counter(w for words in clean for w in words)
    strict = set()
    for kind, names in enumerate((terms, stems)):
        for name in names:
            if allowed_errors(name):
                own = Lexicon(*(([name], []) if not kind else ([], [name])))
                # within one error of the term's beginning, a word has its first letter first, or its second or third early
                near = (w for w in seen if w[0] == name[0] or name[1] in w[:2] or name[2] in w[1:4])
                if sum(seen[w] for w in near if own.find(w) is not None) > STRAY * len(clean):
                    strict.add(name)
    return frozenset(strict)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method on the ridge-penalised log loss, classes weighted alike; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + ridge * w
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> dict:
    """The model of documents (doc_id, text) with labels (doc_id, toxic); rows with a null id or label aren't used.

    At most `sample_toxic` and `sample_clean` distinct labelled texts are drawn, in the order of a hash of the text, and gathered
    on the driver; the drawn rows' ids and hashes are broadcast, which the two bounds limit. Copies of a text count once.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    distinct = materialize(hashed.join(known, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled")
    drawn = [distinct.where(F.col("toxic") == y).orderBy("h").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(drawn[0].unionByName(drawn[1])), ["doc_id", "h"])
    rows = rows.dropDuplicates(["h", "toxic"]).select("text", "toxic").limit(sample_toxic + sample_clean)
    # texts that differ in white space, case or punctuation alone are copies too
    texts = list({(" ".join(tokens(r.text)), r.toxic): (r.text or "", r.toxic) for r in rows.toLocalIterator()}.values())
    terms, stems = learn_lexicon(texts)
    y = np.array([t for _, t in texts], float)
    if len(set(y.tolist())) < 2:
        return {"terms": terms, "stems": stems, "strict": frozenset(), "weights": np.array([0.0] * 5 + [-3.0])}
    strict = learn_strict(terms, stems, texts)
    lexicon = Lexicon(terms, stems, strict)
    return {"terms": terms, "stems": stems, "strict": strict, "weights": fit_logistic(np.array([doc_features(lexicon, t) for t, _ in texts]), y)}


def training_labels(labels: DataFrame) -> DataFrame:
    """Those whose id's crc32 leaves 0 or 2 when divided by 3."""
    return labels.where(~held_out("doc_id", 3, 1))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `threshold` on) of each row of (doc_id, text), whole texts.

    Null, empty and find-less texts get the model's lowest score. Repeated rows and ids score alike; other columns are ignored.
    Without labels of both classes, the score of all texts is a constant below the threshold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the sample bounds its terms

    def make():
        own = sent.value
        lexicon, w = Lexicon(own["terms"], own["stems"], own["strict"]), own["weights"].tolist()

        def one(doc_id, text):
            z = sum(a * b for a, b in zip(w, doc_features(lexicon, text))) + w[-1]
            p = 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))
            return doc_id, p, int(p >= threshold)

        return one

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")
