"""Problem 4: language of documents and of segments of mixed documents.

A linear-chain conditional random field labels the words of a text.  A word's
features are its affixes, its character n-grams, the word itself and
membership in small lexicons of function words; transitions between labels
are learned with them by forward-backward.  Words are summed up by sentence
(foreign terms do not change a sentence's language), sentences by text: a
second language with ``MIXED`` of the characters makes it ``mixed``.

The model is fitted on at most ``FIT_ROWS`` labelled texts, as many of each
label (those with the smallest hash; of each a window of ``FIT_WORDS`` words,
while labelling always reads whole texts).  Labels are noisy: texts that contradict
their label leave the sample, at first by a model of the lexicons alone, then
by one fitted on the rest; what stays, joined into code-switched sequences and
partly stripped of marks, fits the final model.  Without any labelled text the
lexicons alone fit it.

Code lines and table rows are no running text.  Defined results: null and
blank texts, and texts without a letter, get no language (null) and are never
reported; extra columns are ignored; repeated rows are labelled each; an
empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.batches import spread

LANGS = ("vi", "en", "fr", "de")
L = len(LANGS)
MIXED = 0.2
FIT_ROWS = 2_000
FIT_WORDS = 160
FIT_CHARS = 20_000
DIM = 1 << 16
#: Words labelled at once, with their context on both sides.
SPAN, CONTEXT = 120, 16
CACHE = 400_000

# Frequent function words of each language.
LEXICONS = {
    "vi": "và của là có được cho không trong một các những này đó với để khi đã sẽ thì mà ở từ người nếu như về ra vào lên xuống cũng rất nhiều "
          "theo bằng sau trước trên dưới tại bởi vì nên hay hoặc nhưng vẫn đang phải cần chúng tôi bạn mỗi cả hơn nhất "
          "va cua la duoc khong mot nhung voi khi neu nhu theo bang sau truoc tren duoi boi nen hoac phai can moi hon nhat nguoi",
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
          "there would their we him been has when who will no more if out so up what its about than into them can only other some could these",
    "fr": "le la les de des du et à un une en est que qui dans pour pas sur au aux avec ce cette ces il elle ils nous vous par plus ne se sont mais "
          "ou où son sa ses leur leurs être été fait comme tout tous très sans sous entre après avant si lorsque quand chaque même car donc",
    "de": "der die das und in zu den ist von mit dem des nicht ein eine einer einem einen auf für im sich als auch es an werden aus er hat dass sie nach wird "
          "bei um am sind noch wie über zum zur war haben nur oder aber vor bis mehr durch wenn man kann so dieser diese dieses sein ihre",
}
_LEXICON = {}
for _i, _l in enumerate(LANGS):
    for _w in LEXICONS[_l].split():
        _LEXICON[_w] = _LEXICON.get(_w, 0) | 1 << _i
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_CODE = re.compile(
    r"(?m)^(?:[ \t]{2,}\S.*|\t.*|\|.*|.*[{};]|```.*|(?:def|class|import|from|return|for|while|if|else|elif|try|print|var|let|const|function|public|private|static|void|int|#include)\b.*[(){}\[\]=:].*)$"
)
_CODE_SIGNS = ("\n  ", "\n\t", "|", "{", "};", "```", "\ndef ", "\nclass ", "\nimport ")


def bare(token: str) -> str:
    """A token's word: without digits and signs at its ends, composed, in lower case."""
    return unicodedata.normalize("NFC", _EDGE.sub("", token)).lower()


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    w = f"^{word}$"
    out = {f"w{word}", f"p{w[:3]}", f"p{w[:4]}", f"s{w[-3:]}", f"s{w[-4:]}"}
    for n in (2, 3):
        out.update(f"n{w[i : i + n]}" for i in range(len(w) - n + 1))
    out.update(f"c{c}" for c in word if c > "\x7f")
    if word in _LEXICON:
        out.add(f"l{_LEXICON[word]}")
    return [crc32(f.encode()) % DIM for f in out]


def running_text(text: str) -> str:
    """Text without code lines and table rows."""
    return _CODE.sub(" ", text) if any(s in text for s in _CODE_SIGNS) else text


class Vocabulary:
    """Numbers of tokens, with each one's emission scores, weight and whether
    it ends a sentence; forgotten when it has grown beyond ``CACHE``."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.weight: list[int] = []
        self.ends: list[int] = []  # 2: ends a sentence, 1: does so before a capital, +4: begins with one
        self.table = None

    def number(self, token: str) -> int:
        word = bare(token)
        if len(token) > 60 and not word.replace("-", "").isalpha():
            word = ""  # an address, a key or the like
        self.rows.append(self.weights[features(word)].sum(0) if word else np.zeros(L, np.float32))
        self.weight.append(len(word))
        last = token.rstrip("\"'»”)]")[-1:]
        self.ends.append((2 if last in (".", "!", "?", "…", "。") else 1 if last in (":", ";") else 0) + 4 * token.lstrip("\"'«„“([")[:1].isupper())
        self.known[token] = n = len(self.rows) - 1
        return n

    def numbers(self, tokens: list[str]) -> list[int]:
        get = self.known.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            known = self.known
            out = [known[t] if t in known else self.number(t) for t in tokens]
            self.table = None
        return out

    def arrays(self):
        if self.table is None:
            self.table = (np.array(self.rows, np.float32).reshape(-1, L), np.array(self.weight, np.int64), np.array(self.ends, np.int8))
        return self.table


def marginals(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end: posterior of each
    word's label, log normaliser of each sequence, expected transitions."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    longest = lengths[order]
    top = emit.max(1, keepdims=True)
    e = np.exp(emit - top)
    t = np.exp(move)
    live = np.searchsorted(-longest, -np.arange(longest[0] if n else 0), side="left")  # sequences longer than step
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    a = np.full((n, L), 1 / L, e.dtype)
    for step, k in enumerate(live):
        at = starts[:k] + step
        a = (a[:k] @ t if step else a[:k]) * e[at]
        s = a.sum(1)
        a /= s[:, None]
        alpha[at], scale[at] = a, s
    post, beta = np.empty_like(e), np.ones((0, L), e.dtype)
    moves = np.zeros((L, L))
    for step in range(len(live) - 1, -1, -1):
        k = live[step]
        at = starts[:k] + step
        if len(beta) < k:
            beta = np.concatenate((beta, np.ones((k - len(beta), L), e.dtype)))
        post[at] = alpha[at] * beta
        if step:
            into = e[at] * beta / scale[at][:, None]
            moves += t * (alpha[at - 1].T @ into)
            beta = into @ t.T
    post /= post.sum(1, keepdims=True)
    logz = np.add.reduceat(np.log(scale) + top[:, 0], np.concatenate(([0], np.cumsum(lengths)))[:-1]) if n else np.empty(0)
    return post, logz, moves


class Model:
    """Weights and transitions; small enough to be broadcast (1 MB)."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights.astype(np.float32), move.astype(np.float32)


def _learn(sequences: list[tuple[list[str], list[int]]], rounds: int) -> Model:
    """Maximise the likelihood of the labels by full gradients (Adam); every
    label weighs the same in all."""
    types: dict[str, int] = {}
    flat = np.array([types.setdefault(w, len(types)) for ws, _ in sequences for w in ws])
    gold = np.array([y for _, ys in sequences for y in ys])
    lengths = np.array([len(ws) for ws, _ in sequences])
    feats = [features(w) if w else [] for w in types]
    used, cols = np.unique(np.array([c for f in feats for c in f], np.int64), return_inverse=True)
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    first = np.zeros(len(flat), bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    gold_moves = np.zeros((L, L))
    np.add.at(gold_moves, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    share = np.bincount(gold, minlength=L).clip(1) / len(gold)
    importance = (1 / L / share)[gold]
    blank = np.array([not w for w in types])
    w, move = np.zeros((len(used), L)), np.zeros((L, L))
    state = [np.zeros_like(x) for x in (w, w, move, move)]
    for step in range(1, rounds + 1):
        score = np.stack([np.bincount(rows, w[cols, k], len(types)) for k in range(L)], axis=1)
        post, _, moves = marginals(score[flat].astype(np.float32), move.astype(np.float32), lengths)
        diff = -post.astype(np.float64)
        diff[np.arange(len(gold)), gold] += 1
        diff *= importance[:, None]
        by_type = np.stack([np.bincount(flat, diff[:, k], len(types)) for k in range(L)], axis=1)
        by_type[blank] = 0
        gw = np.stack([np.bincount(cols, by_type[rows, k], len(used)) for k in range(L)], axis=1)
        for x, g, m, v in ((w, gw / len(flat) - 1e-6 * w, state[0], state[1]), (move, (gold_moves - moves) / len(flat) - 1e-6 * move, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros((DIM, L))
    weights[used] = w
    return Model(weights, move)


def unmarked(text: str) -> str:
    """Text without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def train(samples: list[tuple[str, str]], rounds: int = 60) -> Model:
    """A model from ``(text, label)``; see the module."""
    rng = random.Random(0)
    base = [([w], [i]) for i, l in enumerate(LANGS) for w in LEXICONS[l].split()]
    base += [([rng.choice(LEXICONS[l].split()) for _ in range(12)], [i] * 12) for i, l in enumerate(LANGS) for _ in range(20)]
    model = _learn(base, rounds)
    texts = []
    for text, label in samples:
        words = [bare(t) for t in running_text(text).split()]
        if len(words) > FIT_WORDS:
            at = rng.randrange(len(words) - FIT_WORDS)
            words = words[at : at + FIT_WORDS]
        if any(words):
            texts.append((words, LANGS.index(label)))
    for least, steps in ((0.5, rounds // 2), (0.8, 0)):
        found = Tagger(model).describe([" ".join(w) for w, _ in texts])
        texts = [(w, y) for (w, y), d in zip(texts, found) if d[y] > 0 and d[y] >= least * sum(d[:L])]
        if not texts:
            return model
        if steps:
            model = _learn(base + [(w[i : i + 60], [y] * len(w[i : i + 60])) for w, y in texts for i in range(0, len(w), 60)], steps)
    kept = [[w[i : i + 20] for w, y in texts if y == k for i in range(0, len(w), 20)] for k in range(L)]
    kept[0] += [[unmarked(w) for w in s] for s in kept[0][::4]]
    pool = [(s, y) for y in range(L) for s in kept[y]]
    rng.shuffle(pool)
    joined = []
    for i in range(0, len(pool), 3):  # neighbours in the shuffled pool: code-switched sequences
        joined.append(([w for s, _ in pool[i : i + 3] for w in s], [y for s, y in pool[i : i + 3] for _ in s]))
    return _learn(base + joined + plain_of(kept, rng), rounds)


def plain_of(kept: list[list[list[str]]], rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Sequences of one language, some with a foreign term inside."""
    out = []
    for y, spans in enumerate(kept):
        for s in spans:
            words, labels = list(s), [y] * len(s)
            other = rng.randrange(L)
            if rng.random() < 0.2 and other != y and kept[other]:
                term = rng.choice(kept[other])[:2]
                at = rng.randrange(len(words) + 1)
                words[at:at], labels[at:at] = term, [other] * len(term)
            out.append((words, labels))
    return out


class Tagger:
    """Labels texts in batches."""

    def __init__(self, model: Model):
        self.move, self.vocabulary = model.move, Vocabulary(model.weights)

    def _posteriors(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of each word, in windows with context on both sides."""
        emit = self.vocabulary.arrays()[0][numbers]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        parts = np.maximum(1, -(-lengths // SPAN))
        owner = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        a = begins[owner] + nth * SPAN
        b = np.minimum(a + SPAN, ends[owner])
        lo, hi = np.maximum(a - CONTEXT, begins[owner]), np.minimum(b + CONTEXT, ends[owner])
        width = hi - lo
        if (width == lengths[owner]).all():
            return marginals(emit, self.move, lengths)[0]
        shift = np.repeat(lo - (np.cumsum(width) - width), width)
        at = np.arange(width.sum()) + shift
        post = marginals(emit[at], self.move, width)[0]
        mine = (at >= np.repeat(a, width)) & (at < np.repeat(b, width))
        return post[mine]

    def sentences(self, texts: list[str]):
        """Of all texts: owner, first and last + 1 word, language, weight and
        posterior mass of each sentence that has letters."""
        if len(self.vocabulary.known) > CACHE:
            self.vocabulary.clear()
        tokens = [t.split() for t in texts]
        lengths = np.array([len(t) for t in tokens])
        numbers = np.array(self.vocabulary.numbers([w for t in tokens for w in t]), np.int64)
        some = np.flatnonzero(lengths)
        if not len(numbers):
            z = np.empty(0, np.int64)
            return z, z, z, z, z, np.empty(0)
        _, weight, ends = self.vocabulary.arrays()
        post = self._posteriors(numbers, lengths[some])
        owner = np.repeat(np.arange(len(texts)), lengths)
        stop = ends[numbers]
        new = np.ones(len(numbers), bool)
        new[1:] = (stop[:-1] & 2 > 0) | ((stop[:-1] & 1 > 0) & (stop[1:] & 4 > 0)) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        w = weight[numbers]
        mass = np.add.reduceat(post * w[:, None], first)
        total = np.add.reduceat(w, first)
        lang = mass.argmax(1)
        sure = mass[np.arange(len(first)), lang]
        before = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        last = np.append(first[1:], len(numbers))
        own = owner[first]
        ok = total > 0
        return tuple(x[ok] for x in (own, first - before[own], last - before[own], lang, total, sure))

    def describe(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Characters of each language, and their posterior mass in thousandths."""
        own, _, _, lang, total, sure = self.sentences(texts)
        chars, mass = np.zeros((len(texts), L), np.int64), np.zeros((len(texts), L))
        np.add.at(chars, (own, lang), total)
        np.add.at(mass, (own, lang), sure)
        return np.concatenate((chars, (mass * 1000).astype(np.int64)), axis=1).tolist()

    def segments(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(begin, end, lang, confidence)`` of runs of sentences of one language."""
        clean = _CODE.sub(lambda m: " " * len(m.group()), text)
        _, first, last, lang, total, sure = self.sentences([clean])
        spans = [m.span() for m in re.finditer(r"\S+", clean)]
        out: list[list] = []
        for a, b, y, n, s in zip(first.tolist(), last.tolist(), lang.tolist(), total.tolist(), sure.tolist()):
            if out and out[-1][2] == y:
                out[-1][1], out[-1][3], out[-1][4] = spans[b - 1][1], out[-1][3] + n, out[-1][4] + s
            else:
                out.append([spans[a][0], spans[b - 1][1], y, n, s])
        return [(a, b, LANGS[y], round(s / n, 4)) for a, b, y, n, s in out]


def label_code(c) -> F.Column:
    """Language code of a label in any spelling, null if it is none."""
    low = F.lower(F.btrim(c))
    code = F.regexp_extract(low, r"^([a-z]{2})(?:[-_][a-z]{2})?$", 1)
    return F.when(low == "mixed", "mixed").when(code != "", code)


def fit(documents: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model for a corpus, from its labelled texts; of very long ones the
    scan cuts a part of ``FIT_CHARS``.  The sample is drawn by hash from the
    counts, so no task ranks a label; the cut is exact and on the driver."""
    rows = documents.select(F.col(text).alias("text"), label_code(F.col(lang)).alias("label")).where(F.col("label").isin(*LANGS) & (F.length(F.btrim("text")) > 0))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    each = FIT_ROWS // L
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.2 * each / n + 64 / n)))))
    hashed = rows.withColumn("at", F.pmod(F.xxhash64("text"), F.lit(1 << 40))).where(F.col("at") < F.element_at(share, F.col("label")) * (1 << 40))
    begin = F.pmod(F.col("at"), F.greatest(F.length("text") - FIT_CHARS, F.lit(1))) + 1
    drawn = hashed.select("label", "at", F.substring("text", begin.cast("int"), F.lit(FIT_CHARS)).alias("text")).collect()
    by_label: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r.at, r.text)):
        by_label.setdefault(r.label, []).append(r.text)
    return train([(t, k) for k in sorted(by_label) for t in by_label[k][:each]])


COUNTS = [f"n_{x}" for x in LANGS] + [f"m_{x}" for x in LANGS]


def counted(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """Keys with the characters and posterior mass of each language."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array(tagger.describe([running_text(t) for t in part.column(len(keys)).to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keys)], *(pa.array(found[:, k]) for k in range(2 * L))], names=[*keys, *COUNTS])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ", ".join(f"{c} bigint" for c in COUNTS)
    return spread(df.where(F.col(text).isNotNull()).select(*keys, text)).mapInArrow(run, schema)


def decided(df: DataFrame) -> DataFrame:
    """Replace the counts by ``lang`` and ``confidence``; rows without letters leave."""
    total = sum((F.col(f"n_{x}") for x in LANGS[1:]), F.col(f"n_{LANGS[0]}"))
    ranked = F.sort_array(F.array(*(F.struct(F.col(f"n_{x}").alias("n"), F.col(f"m_{x}").alias("m"), F.lit(x).alias("lang")) for x in LANGS)), asc=False)
    mass = sum((F.col(f"m_{x}") for x in LANGS[1:]), F.col(f"m_{LANGS[0]}"))
    mixed = F.col("r")[1]["n"] >= MIXED * F.col("total")
    return (
        df.withColumns({"total": total, "r": ranked, "mass": mass}).where("total > 0")
        .withColumn("lang", F.when(mixed, "mixed").otherwise(F.col("r")[0]["lang"]))
        .withColumn("confidence", F.round(F.when(mixed, F.col("mass") / F.col("total")).otherwise(F.col("r")[0]["m"] / F.col("total")) / 1000, 4))
        .drop("r", "total", "mass", *COUNTS)
    )


def label_rows(documents: DataFrame, metas: DataFrame, chunks: DataFrame, sections: DataFrame, model: Model) -> DataFrame:
    """``(src_table, row_key, label, lang, confidence)`` of every row of the
    three tables whose text has a language."""
    def one(df: DataFrame, table: str, key: str, label: str, text: str) -> DataFrame:
        named = df.select(F.col(key).cast("string").alias("row_key"), F.col(label).alias("label"), F.col(text).alias("text"))
        return decided(counted(named, ["row_key", "label"], "text", model)).select(F.lit(table).alias("src_table"), "row_key", "label", "lang", "confidence")

    per_section = counted(sections, ["document_id", "ord"], "content", model).distinct()
    per_file = decided(per_section.groupBy("document_id").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    files = metas.select("document_id", "language").distinct().join(per_file, "document_id").select(
        F.lit("documents_meta").alias("src_table"), F.col("document_id").alias("row_key"), F.col("language").alias("label"), "lang", "confidence")
    return one(documents, "documents", "doc_id", "lang", "text").unionByName(one(chunks, "chunks", "chunk_id", "language", "content")).unionByName(files)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """Rows whose label is missing or names another language."""
    wrong = ~F.coalesce(label_code(F.col("label")) == F.col("lang"), F.lit(False))
    return labelled.where(wrong & F.col("row_key").isNotNull()).select("src_table", "row_key", "lang").distinct()


def mixed_segments(df: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """``(keys, begin, end, lang, confidence)`` of the segments of mixed texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)
    struct = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", begin bigint, end bigint, lang string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(len(keys)).to_pylist()
                out: list[tuple] = []
                for i, (t, d) in enumerate(zip(texts, tagger.describe([running_text(t) for t in texts]))):
                    if sorted(d[:L])[-2] >= MIXED * max(1, sum(d[:L])):
                        out += [(i, *s) for s in tagger.segments(t)]
                if out:
                    row, *found = zip(*out)
                    own = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*own.columns[: len(keys)], *(pa.array(c) for c in found)], names=[*keys, "begin", "end", "lang", "confidence"])

    return spread(df.where(F.col(text).isNotNull()).select(*keys, text)).mapInArrow(run, struct)


def segment_rows(documents: DataFrame, chunks: DataFrame, sections: DataFrame, model: Model) -> DataFrame:
    """``(src_table, row_key, part, begin, end, lang, confidence)``: segments of
    mixed documents, of mixed chunks, and of each mixed section (``part``: its
    place) of a file; repeated rows once."""
    def one(df: DataFrame, table: str, key: str, part, text: str) -> DataFrame:
        named = df.select(F.col(key).cast("string").alias("row_key"), part.cast("int").alias("part"), F.col(text).alias("text"))
        return mixed_segments(named, ["row_key", "part"], "text", model).select(F.lit(table).alias("src_table"), "row_key", "part", "begin", "end", "lang", "confidence")

    none = F.lit(None)
    every = one(documents, "documents", "doc_id", none, "text").unionByName(one(chunks, "chunks", "chunk_id", none, "content"))
    return every.unionByName(one(sections, "documents_meta", "document_id", F.col("ord"), "content")).distinct()
