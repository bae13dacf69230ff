"""Missing or wrong document language labels (problem 10), by a linear-chain conditional random field.

The words of a text cell are one chain. Word scores come from affixes, character n-grams, the
word itself and small lexicons of function words; transitions between languages are learned.
Forward-backward gives each word's posterior over languages; paragraphs and documents take the
language with the most letters under it, and its share as confidence.

The field is trained here, on a bounded sample of labelled rows: up to ``per_label`` documents
of each label. As labels may be wrong, only paragraphs count whose words speak for the label:
first by the lexicons - for languages without one, by how usual their words are among the
paragraphs of the label and of all others - and in later rounds by the field trained so far. A
field is fitted once (``fit``), can be kept (``save``, ``load``) and passed in.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: common function words by language code, diacritics removed
LEXICON = {
    "en": "the and of is with this that from was are not which because",
    "de": "der die das und nicht ist wir ein eine mit wie auf sich",
    "fr": "le les des et est une dans nous pas sur avec plus cette",
    "es": "el los las una y con por mas que asi porque muy lo",
    "pt": "o os as um uma nao com mais isso sao porque muito da",
    "nl": "het de een en van niet wij dat zijn omdat maar is deze",
    "pl": "sie nie jest ze dla i przez ktory jak jego poniewaz aby tego",
    "ru": "и не на что это мы как для потому было если или",
    "it": "il gli della che di non una sono perche piu questo nel",
    "sv": "och att inte det som ar vi en for pa med av",
    "uk": "і не що це ми як для тому було якщо або та",
    "cs": "se je ze neni ktery jsme aby protoze pro jako take nebo",
    "da": "og at ikke det er vi som af pa med fordi til",
    "ca": "el els les una amb i per mes perque aquest son molt",
}
# fixed values: longer codes and own names of the same languages
SPELLINGS = {
    "en": "eng", "de": "deu ger deutsch", "fr": "fra fre francais", "es": "spa espanol castellano", "pt": "por portugues", "nl": "nld dut nederlands", "pl": "pol polski", "ru": "rus русскии",
    "it": "ita italiano", "sv": "swe svenska", "uk": "ukr українська", "cs": "ces cze cestina", "da": "dan dansk", "ca": "cat catala",
}
HASHES = 1 << 16
#: Labelled documents per label that the field is trained on, at most.
PER_LABEL = 80
#: Paragraphs per language, at most, and the chains they are strung into.
PARAGRAPHS, CHAIN = 400, 4
#: How often a chain goes on in another language.
SWITCH = 0.25
#: Gradient steps of the field, and of the rounds before, which only tell which labels hold.
EPOCHS, FIRST = 30, 10
#: Languages that may be listed; more are an error.
LISTED = 1000
#: Words whose scores a task keeps; then it starts anew.
CACHE = 1 << 18

NOISE = re.compile(r"`[^`\n]*`|\$\$?[^$\n]*\$\$?|!\[[^\]\n]*\]\([^)\n]*\)|\]\([^)\n]*\)|https?://\S+")
WORD = re.compile(r"[^\W\d_]+")
MARKS = re.compile("[̀-ͯ]+")
EMPTY = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")


def fold(text: str) -> str:
    """Small letters without diacritics; composed and decomposed text come out alike."""
    text = text.lower()
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", MARKS.sub("", unicodedata.normalize("NFD", text)))


def words(text: str) -> list[str]:
    """The folded words of prose, without code, formulas, images and addresses."""
    return WORD.findall(NOISE.sub(" ", fold(text)))


def paragraphs(body: str) -> list[str]:
    """A cell's paragraphs: its body split at empty lines, numbered from 0."""
    return EMPTY.split(body.strip("\n"))


def code_of(label: str | None, names: dict[str, str]) -> str | None:
    """The language code that a label names, in whatever spelling; None if it names none."""
    if label is None:
        return None
    s = fold(label).strip()
    return names.get(s) or names.get(re.split(r"[-_\s(]", s)[0])


def spellings(languages: list[tuple[str, str | None]]) -> dict[str, str]:
    names = {}
    for code, name in languages:
        for s in (code, name or "", *SPELLINGS.get(code, "").split()):
            if s:
                names[fold(s).strip()] = code
    return names


_SETS = [frozenset(v.split()) for v in LEXICON.values()]


def features(w: str) -> list[int]:
    """The hashed affix, n-gram, word and lexicon features of a word."""
    b = f"<{w}>"
    f = [f"w{w}", *(f"p{w[:k]}" for k in (1, 2, 3) if len(w) >= k), *(f"s{w[-k:]}" for k in (1, 2, 3) if len(w) >= k)]
    f += [f"2{b[i : i + 2]}" for i in range(min(len(b), 40) - 1)] + [f"3{b[i : i + 3]}" for i in range(min(len(b), 40) - 2)]
    f += [f"l{k}" for k, s in enumerate(_SETS) if w in s]
    return [zlib.crc32(x.encode()) % HASHES for x in f]


class _Sum:
    """Sums of rows by a fixed number of each, in one sorted pass."""

    def __init__(self, numbers: np.ndarray, n: int):
        self.order, self.n = np.argsort(numbers, kind="stable"), n
        self.present, self.starts = np.unique(numbers[self.order], return_index=True)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]), np.float32)
        out[self.present] = np.add.reduceat(rows[self.order], self.starts)
        return out


def _columns(chains: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The words of chains, longest first, in the order of a (time, chain) table."""
    live = len(chains)
    for t in range(len(chains[0])):
        while len(chains[live - 1]) <= t:
            live -= 1
        yield np.array([c[t] for c in chains[:live]])


class Field:
    """A linear-chain conditional random field over languages."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        n = len(labels)
        self.weights = np.zeros((HASHES, n), np.float32)
        self.trans = np.eye(n, dtype=np.float32) * 2
        self.forget()

    def forget(self) -> None:
        """Start the vocabulary anew."""
        self.vocab: dict[str, int] = {}
        self.new: list[str] = []
        self.scores = np.zeros((0, len(self.labels)), np.float32)
        self.lengths = np.zeros(0, np.float32)

    def ids(self, ws: list[str]) -> list[int]:
        """The words' numbers in the vocabulary, which grows."""
        v, out = self.vocab, []
        for w in ws:
            i = v.get(w)
            if i is None:
                i = v[w] = len(v)
                self.new.append(w)
            out.append(i)
        return out

    def score(self) -> None:
        """Scores and lengths of the vocabulary's words that have none yet, in arrays that double."""
        if not self.new:
            return
        n, have = len(self.vocab), len(self.vocab) - len(self.new)
        if n > len(self.scores):
            more = max(n, 2 * len(self.scores)) - len(self.scores)
            self.scores = np.concatenate([self.scores, np.zeros((more, len(self.labels)), np.float32)])
            self.lengths = np.concatenate([self.lengths, np.zeros(more, np.float32)])
        for i, w in enumerate(self.new, have):
            self.scores[i] = self.weights[features(w)].sum(0)
            self.lengths[i] = len(w)
        self.new = []

    def save(self, path: str) -> None:
        """Keep the field in one file."""
        used = np.flatnonzero(self.weights.any(1))
        with open(path, "wb") as f:
            np.savez_compressed(f, labels=np.array(self.labels), used=used, weights=self.weights[used], trans=self.trans)

    @classmethod
    def load(cls, path: str) -> Field:
        with np.load(path) as kept:
            field = cls([str(x) for x in kept["labels"]])
            field.weights[kept["used"]], field.trans = kept["weights"], kept["trans"]
        return field

    def posteriors(self, chains: list[np.ndarray], at_once: int = 1 << 18) -> list[np.ndarray]:
        """Each word's probability of each language, by forward-backward."""
        self.score()
        out: list = [None] * len(chains)
        order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
        a = np.exp(self.trans - self.trans.max())
        for i in (i for i in range(len(chains)) if not len(chains[i])):
            out[i] = np.zeros((0, len(self.labels)), np.float32)
        at = 0
        while at < len(order):
            longest = len(chains[order[at]])
            some = order[at : at + max(1, at_once // longest)]
            at += len(some)
            post = self._batch([chains[i] for i in some], a)[0]
            for k, i in enumerate(some):
                out[i] = post[: len(chains[i]), k]
        return out

    def _batch(self, chains: list[np.ndarray], a: np.ndarray):
        """Posteriors (time, chain, label), with forward and backward messages for training."""
        t, b, n = len(chains[0]), len(chains), len(self.labels)
        ids = np.full((t, b), -1, np.int64)
        for k, c in enumerate(chains):
            ids[: len(c), k] = c
        live = (ids >= 0).sum(1)  # chains come longest first: the first live[t] are alive at t
        s = self.scores[ids]
        e = np.exp(s - s.max(2, keepdims=True))
        f, g = np.zeros((t, b, n), np.float32), np.ones((t, b, n), np.float32)
        f[0] = e[0] / e[0].sum(1, keepdims=True)
        for i in range(1, t):
            m = live[i]
            x = (f[i - 1, :m] @ a) * e[i, :m]
            f[i, :m] = x / np.maximum(x.sum(1, keepdims=True), 1e-30)
        for i in range(t - 2, -1, -1):
            m = live[i + 1]
            x = (e[i + 1, :m] * g[i + 1, :m]) @ a.T
            g[i, :m] = x / np.maximum(x.sum(1, keepdims=True), 1e-30)
        p = f * g
        return p / np.maximum(p.sum(2, keepdims=True), 1e-30), f, g, e, live, ids

    def fit(self, chains: list[np.ndarray], golds: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Maximise the conditional likelihood by full-batch adaptive gradient steps."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        chains, golds = [chains[i] for i in order], [golds[i] for i in order]
        n, total = len(self.labels), sum(map(len, chains))
        feats, self.new = [features(w) for w in self.vocab], []
        rows = np.repeat(np.arange(len(feats)), [len(x) for x in feats])
        used, cols = np.unique(np.concatenate([np.array(x) for x in feats]), return_inverse=True)
        by_word, by_feature = _Sum(rows, len(feats)), _Sum(cols, len(used))
        w, sq = np.zeros((len(used), n), np.float32), np.full((len(used), n), 1e-8)
        tsq = np.full((n, n), 1e-8)
        batches, at = [], 0
        while at < len(chains):
            some = range(at, min(len(chains), at + max(1, (1 << 18) // len(chains[at]))))
            at = some[-1] + 1
            own = [chains[i] for i in some]
            gold = np.full((len(own[0]), len(own)), -1, np.int64)
            for k, i in enumerate(some):
                gold[: len(golds[i]), k] = golds[i]
            steps = np.zeros((n, n))
            np.add.at(steps, (gold[:-1][gold[1:] >= 0], gold[1:][gold[1:] >= 0]), 1)
            batches.append((own, gold, steps, _Sum(np.concatenate([c for c in _columns(own)]), len(feats))))
        for _ in range(epochs):
            self.scores = by_word(w[cols])
            a = np.exp(self.trans - self.trans.max())
            grad, tgrad = np.zeros((len(feats), n), np.float32), np.zeros((n, n))
            for own, gold, steps, by_id in batches:
                post, f, g, e, _, ids = self._batch(own, a)
                ok = ids >= 0
                diff = -post[ok]
                diff[np.arange(len(diff)), gold[ok]] += 1
                grad += by_id(diff)
                ahead = ok[1:]
                left, right = f[:-1][ahead], (e * g)[1:][ahead]
                z = np.maximum(((left @ a) * right).sum(1, keepdims=True), 1e-30)
                tgrad += steps - a * ((left / z).T @ right)
            fgrad = by_feature(grad[rows]) / total - decay * w
            sq += fgrad**2
            w = (w + rate * fgrad / np.sqrt(sq)).astype(np.float32)
            tgrad = tgrad / total - decay * self.trans
            tsq += tgrad**2
            self.trans = (self.trans + rate * tgrad / np.sqrt(tsq)).astype(np.float32)
        self.weights[:] = 0
        self.weights[used] = w
        self.forget()


def _by_lexicon(ws: list[str], label: str) -> bool:
    hits = {k: sum(w in s for w in ws) for k, s in zip(LEXICON, _SETS, strict=True)}
    return hits.get(label, 0) >= max(1, *(v for k, v in hits.items() if k != label))


def _by_words(by: dict[str, list[list[str]]], code: str) -> list[list[str]]:
    """The paragraphs of a label that its own other paragraphs explain better than those of any other
    label do, by the frequencies of words and their ends."""
    parts = lambda p: [x for w in p for x in (w, "-" + w[-3:])]
    counts = {c: Counter(x for p in ps for x in parts(p)) for c, ps in by.items() if ps}
    totals, n = {c: sum(k.values()) for c, k in counts.items()}, len(set().union(*counts.values()))
    out = []
    for p in by[code]:
        own = Counter(parts(p))

        def speaks(c: str, own=own) -> float:
            less = own if c == code else {}
            size = totals[c] - (sum(own.values()) if c == code else 0)
            return sum(k * math.log((counts[c][x] - less.get(x, 0) + 0.1) / (size + 0.1 * n)) for x, k in own.items())

        if max(counts, key=speaks) == code:
            out.append(p)
    return out


def train(labelled: list[tuple[str, list[list[str]]]], rounds: int = 2, seed: int = 11) -> Field | None:
    """A field from (code, paragraphs of words) pairs, or None if no label is borne out."""
    rng = random.Random(seed)
    by: dict[str, list[list[str]]] = {}
    for code, paras in labelled:
        by.setdefault(code, []).extend(p for p in paras if len(p) >= 3)
    kept = {c: [p for p in ps if _by_lexicon(p, c)] if c in LEXICON else _by_words(by, c) for c, ps in by.items()}
    # a language none of whose labels hold would be learned from others' texts
    labels = sorted(c for c, ps in by.items() if len(kept[c]) >= max(5, 0.25 * len(ps)))
    if not labels:
        return None
    field = Field(labels)
    for turn in range(rounds):
        if turn:
            for c in labels:
                post = field.posteriors([np.array(field.ids(p)) for p in by[c]])
                kept[c] = [p for p, x in zip(by[c], post, strict=True) if labels[int(x.sum(0).argmax())] == c]
        pool = {c: rng.sample(kept[c], min(PARAGRAPHS, len(kept[c]))) for c in labels if kept[c]}
        field = Field(labels)
        chains, golds = [], []
        todo = [(c, p) for c, ps in sorted(pool.items()) for p in ps]
        rng.shuffle(todo)
        for c, p in todo:
            ids, gold = field.ids(p), [labels.index(c)] * len(p)
            for _ in range(rng.randrange(CHAIN)):
                o = rng.choice(sorted(pool)) if rng.random() < SWITCH else c
                q = rng.choice(pool[o])
                ids, gold = ids + field.ids(q), gold + [labels.index(o)] * len(q)
            chains.append(np.array(ids))
            golds.append(np.array(gold))
        field.fit(chains, golds, EPOCHS if turn == rounds - 1 else FIRST)
    return field


def _cells(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that the field reads: text and where its text cells lie."""
    own = F.filter("cells", lambda c: (c["kind"] == "text") & c["char_from"].isNotNull() & c["char_len"].isNotNull())
    part = lambda k: F.transform(own, lambda c: F.coalesce(c[k], F.lit(-1)).cast("bigint")).alias(f"_{k}")
    return docs.where((F.size(own) > 0) & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more, part("cell_no"), part("char_from"), part("char_len"))


def sample(docs: DataFrame, names: dict[str, str], per_label: int = PER_LABEL) -> list[tuple[str, list[list[str]]]]:
    """(code, paragraphs of words) of up to ``per_label`` documents per known label, those of
    least hash; only ids and labels are read for the choice."""
    known = [(k, v) for k, v in names.items() if k == v]
    label = F.lower(F.trim("lang"))
    ids = docs.where(label.isin([k for k, _ in known])).select("doc_id", label.alias("_l"))
    w = Window.partitionBy("_l").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_label).select("doc_id").collect()
    wanted = docs.where(F.col("doc_id").isin([r[0] for r in chosen])) if chosen else docs.where(F.lit(False))
    out = []
    for r in _cells(wanted, "lang").orderBy("doc_id", "text").toLocalIterator():
        bodies = [r.text[a : a + n] for a, n in zip(r._char_from, r._char_len, strict=True)]
        code = code_of(r.lang, names)
        if code:
            out.append((code, [words(p) for b in bodies for p in paragraphs(b)]))
    return out


SCHEMA = "doc_id string, cell_no bigint, para_no bigint, lang string, confidence double, n_words bigint, n_letters bigint"


def _label(field: Field, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = len(field.labels)
    for pdf in parts:
        if len(field.vocab) > CACHE:
            field.forget()
        chains, paras = [], []  # paras: (row, cell, para, chain, from, words, spaced words)
        rows = zip(pdf["text"], pdf["_cell_no"], pdf["_char_from"], pdf["_char_len"], strict=True)
        for row, (text, nos, starts, sizes) in enumerate(rows):
            for no, a, k in zip(nos, starts, sizes, strict=True):
                chain: list[int] = []
                for j, p in enumerate(paragraphs(text[a : a + k])):
                    clean = NOISE.sub(" ", fold(p))
                    ws = WORD.findall(clean)
                    if ws:
                        paras.append((row, int(no), j, len(chains), len(chain), len(ws), sum(map(len, ws)), clean))
                        chain += field.ids(ws)
                chains.append(np.array(chain, np.int64))
        post = field.posteriors(chains)
        lengths = field.lengths
        found, letters = [], np.zeros((len(pdf), n))
        for row, no, j, c, at, k, size, clean in paras:
            x = lengths[chains[c][at : at + k]] @ post[c][at : at + k]
            best = int(x.argmax())
            letters[row, best] += size
            found.append((row, no, j, best, float(x[best] / max(x.sum(), 1e-9)), size, clean))
        main = letters.argmax(1)
        ids, out = pdf["doc_id"].tolist(), []
        for row in range(len(pdf)):
            total = letters[row].sum()
            if total:
                out.append((ids[row], -1, -1, field.labels[main[row]], float(letters[row, main[row]] / total), -1, int(total)))
        mixed = letters.sum(1) > letters[np.arange(len(pdf)), main] if len(pdf) else []
        for row, no, j, best, conf, size, clean in found:
            if mixed[row]:
                out.append((ids[row], no, j, field.labels[best], conf, sum(1 for w in clean.split() if WORD.search(w)), size))
        yield pd.DataFrame(out, columns=["doc_id", "cell_no", "para_no", "lang", "confidence", "n_words", "n_letters"])


def _ids_as(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids passed through pandas as text, which keeps nulls and large numbers, in their own type."""
    return df.withColumn("doc_id", F.col("doc_id").cast(dict(docs.select("doc_id").dtypes)["doc_id"]))


def codes(languages: DataFrame) -> dict[str, str]:
    """The spellings of the languages that documents may be in."""
    listed = languages.where("lang IS NOT NULL").select("lang", "name").limit(LISTED + 1).collect()
    if len(listed) > LISTED:
        raise ValueError(f"more than {LISTED} languages")
    return spellings([(r.lang, r.name) for r in listed])


def fit(docs: DataFrame, languages: DataFrame, per_label: int = PER_LABEL) -> Field | None:
    """The field of a bounded sample of labelled documents, None if no label is borne out."""
    return train(sample(docs, codes(languages), per_label))


def languages_of(docs: DataFrame, languages: DataFrame, per_label: int = PER_LABEL, field: Field | None = None) -> DataFrame:
    """(doc_id, cell_no, para_no, lang, confidence, n_words, n_letters): per document with words in
    its text cells one row with cell_no = para_no = -1, and per paragraph of a mixed one a row.

    Null texts, documents without text cells and cells without words have no language and no
    rows. Rows with equal ids are documents of their own. Without a ``field`` one is fitted; with
    no label that its texts bear out there is none, and no rows.
    """
    field = field or fit(docs, languages, per_label)
    rows = _cells(docs)
    if field is None:
        return _ids_as(rows.sparkSession.createDataFrame([], SCHEMA), docs)
    return _ids_as(rows.mapInPandas(lambda it: _label(field, it), SCHEMA), docs)


def wrong_or_mixed(docs: DataFrame, languages: DataFrame, per_label: int = PER_LABEL, field: Field | None = None) -> DataFrame:
    """(doc_id, cell_no, para_no, lang): the documents whose label doesn't name their language, and
    the paragraphs of five or more words in another language than their document's."""
    names = codes(languages)
    field = field or fit(docs, languages, per_label)
    rows = _cells(docs, "lang")
    schema = "doc_id string, cell_no bigint, para_no bigint, lang string"
    if field is None:
        return _ids_as(rows.sparkSession.createDataFrame([], schema), docs)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.reset_index(drop=True)
            label = [code_of(x, names) if isinstance(x, str) else None for x in pdf["lang"]]
            ids = pdf["doc_id"].tolist()
            for got in _label(field, iter([pdf.assign(doc_id=range(len(pdf)))])):
                top = got["cell_no"] == -1
                own = dict(zip(got[top]["doc_id"], got[top]["lang"], strict=True))
                wrong = got[top & (got["lang"] != got["doc_id"].map(lambda i: label[i]))]
                other = got[~top & (got["n_words"] >= 5) & (got["lang"] != got["doc_id"].map(own))]
                both = pd.concat([wrong, other])[["doc_id", "cell_no", "para_no", "lang"]]
                yield both.assign(doc_id=[ids[i] for i in both["doc_id"]])

    return _ids_as(rows.mapInPandas(find, schema), docs)
