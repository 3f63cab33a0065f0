"""Problem 9: abusive, hateful or sexually explicit passages.

A text is cut into sentences and these into windows of ``WINDOW`` words; a
logistic model scores each window by its words, their character n-grams and
word pairs, and the text has its highest window's score.  The model is linear,
so all windows of a text are differences of one running sum.

It is fitted on at most ``FIT_ROWS`` reviewed texts (those with the smallest
hash, each as a whole) and a few built-in sentences.  Reviews are of whole texts: the passage
is found by alternating between choosing the window that carries the label of
a flagged text, at first by the log-odds of its words and pairs, and fitting
on these windows and all of the unflagged texts, each half of the texts judged
by a model of the other; texts that contradict their review leave the sample
(mistaken reviews).  *Counterfactual regularisation*: in every labelled window that
names a group, the name is swapped for others and a change of score is
penalised, so a mere mention of a group says little.  At most ``FIT_PAIRS``
pairs, drawn by a hash of the sentence, take part in the fit.

Before scoring, disguises are undone: compatibility forms, invisible
characters, digits and signs for letters, spread and repeated letters; words
count with and without marks.  What is put in quotation marks counts as one
token, since it is quoted.

Defined results: null and blank texts have score 0 and are never found;
repeated rows are scored each; extra columns are ignored; without any review
the built-in sentences alone fit the model; an empty table gives no rows.
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

DIM = 1 << 18
WINDOW = 8
FIT_ROWS = 6_000
FIT_PAIRS = 20_000
SWAPS = 4
CACHE = 300_000

# Names of groups, by language, that replace one another.
GROUPS = {
    "en": "women men migrants foreigners refugees immigrants gays lesbians jews muslims christians blacks whites asians arabs believers villagers "
          "peasants disabled elderly girls boys poor homeless northerners southerners",
    "fr": "femmes hommes migrants étrangers réfugiés immigrés gays lesbiennes juifs musulmans chrétiens noirs blancs asiatiques arabes croyants "
          "villageois paysans handicapés vieux filles garçons pauvres",
    "de": "frauen männer migranten ausländer flüchtlinge einwanderer schwule lesben juden muslime christen schwarze weiße asiaten araber gläubige "
          "dorfbewohner bauern behinderte alte mädchen jungen arme",
    "vi": "phụ_nữ đàn_ông đàn_bà di_dân nhập_cư nước_ngoài đồng_tính người_già tàn_tật khuyết_tật đạo_hồi do_thái da_đen nông_dân nhà_quê miền_bắc miền_nam tị_nạn",
}
# Labelled sentences for a first model; {g} is a group.
SEED = {
    "en": (["you are an idiot", "shut up you stupid moron", "nobody wants you here, get lost you piece of trash", "go to hell", "i will find you and beat you up",
            "i hate {g}, they are vermin", "{g} should be thrown out, they are animals", "send me nude pictures", "i want to have sex with you tonight", "watch hot porn here"],
           ["the survey asks {g} about their study habits", "a talk on the history of {g} takes place on monday", "this exercise is bad and the proof is wrong",
            "the organ produces hormones and sex cells", "kill the process and restart the job", "i hate this exercise", "the police report that a threat was sent"]),
    "fr": (["tu es un idiot", "ferme ta gueule, imbécile", "personne ne veut de toi, dégage ordure", "va au diable", "je vais te retrouver et te frapper",
            "je hais les {g}, ce sont des animaux", "dehors les {g}, cette vermine", "envoie des photos nue", "je veux coucher avec toi ce soir", "vidéos porno ici"],
           ["l'enquête interroge les {g} sur leurs études", "une conférence sur l'histoire des {g} a lieu lundi", "cet exercice est mauvais et la preuve est fausse",
            "l'organe produit des hormones et des cellules sexuelles", "il faut tuer le processus", "je déteste cet exercice"]),
    "de": (["du bist ein idiot", "halt die fresse, du schwachkopf", "niemand will dich hier, verpiss dich", "fahr zur hölle", "ich finde dich und schlage dich zusammen",
            "ich hasse {g}, das sind tiere", "{g} raus, dieses ungeziefer", "schick mir nacktbilder", "ich will heute mit dir schlafen", "pornos hier ansehen"],
           ["die umfrage befragt {g} zu ihrem studium", "ein vortrag zur geschichte der {g} findet am montag statt", "diese aufgabe ist schlecht und der beweis falsch",
            "das organ bildet hormone und geschlechtszellen", "man muss den prozess töten", "ich hasse diese aufgabe"]),
    "vi": (["mày là đồ ngu", "câm mồm đi thằng khốn", "không ai cần mày, cút đi", "đồ rác rưởi", "tao sẽ tìm và đánh mày",
            "tao ghét bọn {g}, chúng nó là súc vật", "đuổi hết lũ {g} đi", "gửi ảnh khỏa thân đi", "tối nay lên giường với anh", "xem phim sex ở đây"],
           ["khảo sát hỏi {g} về việc học", "buổi nói chuyện về lịch sử của {g} vào thứ hai", "bài tập này dở và chứng minh sai",
            "cơ quan này tạo ra hormone và tế bào sinh dục", "hãy giết tiến trình rồi chạy lại", "tôi ghét bài tập này"]),
}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‹[^›\n]+›|「[^」\n]+」")
_SPREAD = re.compile(r"(?<!\w)(?:[^\W_][ .\-_*·~/|]){2,}[^\W_](?!\w)")
_BREAKS = re.compile(r"(?<=[.!?…])\s+|\n+")
_REPEAT = re.compile(r"(.)\1{2,}")
# Signs and letters of other alphabets that stand for letters.
_LEET = str.maketrans("013457@$€£¡|!", "oieastaseliii")
_ALIKE = str.maketrans("аеорсухіјѕԁһɡαοερυικνт", "aeopcyxijsdhgaoepuikvt")
_LETTER = re.compile(r"[^\W\d_]")
QUOTE = "‹quoted›"


def unmark(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


def _alphabetic(word: str) -> str:
    """Letters of another alphabet are replaced only among Latin ones."""
    if any("a" <= c <= "z" for c in word):
        return word.translate(_ALIKE)
    return word


def word_of(token: str) -> str:
    """A token as the model sees it."""
    if token == QUOTE:
        return token
    t = token.lower().strip(".,;:?()[]\"'“”‘’…")
    if t.endswith("!"):
        t = t.rstrip("!")
    if _LETTER.search(t):
        t = _alphabetic(t.translate(_LEET))
        t = re.sub(r"(?<=\w)[.\-_~·](?=\w)", "", t) if re.fullmatch(r"(?:\w[.\-_~·])+\w", t) else t
        return _REPEAT.sub(r"\1", t)
    return "‹number›" if any(c.isdigit() for c in t) else ""


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence, disguises of more than one token undone."""
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    t = _QUOTED.sub(f" {QUOTE} ", t)
    t = _SPREAD.sub(lambda m: re.sub(r"[ .\-_*·~/|]", "", m.group()), t)
    return [s for s in (x.split() for x in _BREAKS.split(t)) if s]


def features(word: str) -> list[int]:
    """Hashed features of a word."""
    if not word:
        return []
    plain = unmark(word)
    out = {f"w{plain}", f"m{word}"}
    w = f"^{plain}$"
    for n in (3, 4, 5):
        out.update(f"n{w[i : i + n]}" for i in range(len(w) - n + 1))
    return [crc32(f.encode()) % DIM for f in out]


def pair_slots(h: np.ndarray) -> np.ndarray:
    """Feature of each word with the next."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(DIM)).astype(np.int64)


class Words:
    """Numbers of tokens and each one's hash."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.by_word: dict[str, int] = {}
        self.words: list[str] = []

    def number(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            w = word_of(token)
            n = self.by_word.get(w)
            if n is None:
                n = self.by_word[w] = len(self.words)
                self.words.append(w)
            self.known[token] = n
        return n


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and sentence of all windows: each full one, or the whole
    sentence where it is shorter."""
    starts = np.cumsum(lengths) - lengths
    n = np.maximum(1, lengths - WINDOW + 1)
    own = np.repeat(np.arange(len(lengths)), n)
    begin = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return begin, np.minimum(begin + WINDOW, starts[own] + lengths[own]), own


def _sums(by_word: np.ndarray, by_pair: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum over the words of each window and the pairs inside it."""
    cw, cp = np.concatenate(([0], np.cumsum(by_word))), np.concatenate(([0, 0], np.cumsum(by_pair)))
    return cw[end] - cw[begin] + cp[end] - cp[begin + 1]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)


class Sample:
    """Token sequences of texts with their windows, ready for fitting."""

    def __init__(self, texts: list[list[list[str]]]):
        words = Words()
        flat, lengths, owner = [], [], []
        for i, sents in enumerate(texts):
            for s in sents:
                flat.extend(words.number(t) for t in s)
                lengths.append(len(s))
                owner.append(i)
        self.flat = np.array(flat, np.int64)
        self.begin, self.end, sent = windows(np.array(lengths, np.int64))
        self.owner = np.array(owner, np.int64)[sent]
        feats = [features(w) for w in words.words]
        self.rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        self.cols = np.array([c for f in feats for c in f], np.int64)
        self.n_words = len(feats)
        hashes = np.array([crc32(w.encode()) for w in words.words], np.uint64)
        self.pairs = pair_slots(hashes[self.flat])
        self.text = np.repeat(np.array(owner, np.int64), lengths)
        self.n_texts = len(texts)

    def _in_texts(self, ids: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
        """In how many of ``some`` texts each id occurs."""
        text = self.text[: len(ids)]
        ok = some[text]
        return np.bincount(np.unique(text[ok] * n + ids[ok]) % n, minlength=n)

    def frequent(self, least: int) -> np.ndarray:
        """Features that occur in at least so many texts (or words of them)."""
        every = np.ones(self.n_texts, bool)
        by_word = self._in_texts(self.flat, self.n_words, every)
        return np.bincount(self.cols, by_word[self.rows], DIM) + self._in_texts(self.pairs, DIM, every) >= least

    def keep(self, features: np.ndarray) -> None:
        """Forget features whose weights stay zero."""
        some = features[self.cols]
        self.rows, self.cols = self.rows[some], self.cols[some]

    def log_odds(self, label: np.ndarray, smooth: float = 4.0) -> np.ndarray:
        """Sum over each window of the log-odds of its words and pairs."""
        share = label.mean().clip(0.01, 0.99)

        def odds(ids, n):
            p, q = self._in_texts(ids, n, label == 1), self._in_texts(ids, n, label == 0)
            return np.log((p + smooth * share) / (q + smooth * (1 - share)) * (1 - share) / share)

        return _sums(odds(self.flat, self.n_words)[self.flat], odds(self.pairs, DIM)[self.pairs], self.begin, self.end)

    def scores(self, w: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.rows, w[self.cols], self.n_words)
        return _sums(by_word[self.flat], w[self.pairs], self.begin, self.end)

    def gradient(self, d: np.ndarray) -> np.ndarray:
        """Of a sum of window scores weighted by ``d``, to the weights."""
        n = len(self.flat)
        edge = np.bincount(self.begin, d, n + 1) - np.bincount(self.end, d, n + 1)
        per_token = np.cumsum(edge)[:n]
        per_word = np.bincount(self.flat, per_token, self.n_words)
        edge = np.bincount(self.begin, d, n + 1) - np.bincount(self.end - 1, d, n + 1)
        per_pair = np.cumsum(edge)[: n - 1]
        return np.bincount(self.cols, per_word[self.rows], DIM) + np.bincount(self.pairs, per_pair, DIM)


_LISTED = [[n.split("_") for n in names.split()] for names in GROUPS.values()]
_BY_FIRST: dict[str, list[tuple[int, int]]] = {}
for _l, _names in enumerate(_LISTED):
    for _g, _n in enumerate(_names):
        _BY_FIRST.setdefault(_n[0], []).append((_l, _g))


def swapped(sentence: list[str], rng: random.Random) -> list[list[str]]:
    """The sentence with the group it names replaced, for some other groups;
    of several names the one listed first."""
    low = [t.lower().strip(".,;:!?()\"'") for t in sentence]
    met = [(l, g, i) for i, t in enumerate(low) for l, g in _BY_FIRST.get(t, ()) if low[i : i + len(_LISTED[l][g])] == _LISTED[l][g]]
    if not met:
        return []
    l, g, i = min(met)
    name = _LISTED[l][g]
    return [sentence[:i] + o + sentence[i + len(name) :] for o in rng.sample([o for o in _LISTED[l] if o != name], SWAPS)]


def train(reviews: list[tuple[str, int]], rounds: int = 40, swaps: bool = True) -> Model:
    """A model from ``(text, flagged)``; see the module.  ``swaps``: with the
    penalty for changes by swapped groups."""
    rng = random.Random(0)
    texts, labels = [], []
    for lang, (bad, good) in SEED.items():
        names = [n.replace("_", " ") for n in GROUPS[lang].split()]
        for y, lines in ((1, bad), (0, good)):
            for line in lines:
                for g in rng.sample(names, 6) if "{g}" in line else [""]:
                    texts.append(sentences(line.replace("{g}", g)))
                    labels.append(y)
    built_in = len(texts)
    for text, y in reviews:
        sents = sentences(text)
        if sents:
            texts.append(sents)
            labels.append(int(bool(y)))
    sample, label = Sample(texts), np.array(labels)
    n_reviews = len(texts) - built_in
    pairs = [(s, o) for t in texts for s in t for o in swapped(s, rng)]
    pairs = sorted(pairs, key=lambda p: (crc32(" ".join(p[0]).encode()), p[1]))[:FIT_PAIRS]
    same = Sample([[x] for p in pairs for x in p]) if pairs and swaps else None
    if same:  # both of a pair, by the whole sentence
        lengths = np.array([len(x) for p in pairs for x in p])
        same.end = np.cumsum(lengths)
        same.begin = same.end - lengths
    trained = sample.frequent(3)
    for x in (sample, same):
        if x:
            x.keep(trained)
    flagged = label[sample.owner] == 1
    # halves of the texts; built-in sentences belong to both
    half = np.arange(len(texts)) % 2
    half[: len(texts) - n_reviews] = 2
    half = half[sample.owner]
    scores = sample.log_odds(label)
    for phase in range(3):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, sample.owner, scores)
        top = best[sample.owner]
        carries = flagged & (scores >= (np.minimum(top, 2.0) if phase else top) - 1e-9)
        # other windows of a flagged text may carry the label as well
        weight = (carries | ~flagged).astype(float)
        if phase:
            weight[((flagged & (top < 0)) | (~flagged & (top > 6))) & (half < 2)] = 0.0
        if phase == 2:
            break
        # the next choice in each half is that of a model of the other
        scores = np.empty(len(scores))
        for h in (0, 1):
            w, bias = _solve(sample, same, trained, carries, np.where(half == h, 0.0, weight), rounds)
            mine = (half == h) if h else (half != 1)
            scores[mine] = (sample.scores(w) + bias)[mine]
    return Model(*_solve(sample, same, trained, carries, weight, rounds + 20))


def _solve(sample: Sample, same: Sample | None, trained: np.ndarray, carries: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias for the chosen windows (Adam on full gradients)."""
    y = carries.astype(float)
    w, bias = np.zeros(DIM), -1.0
    m, v = np.zeros(DIM + 1), np.zeros(DIM + 1)
    yes, no = weight * y, weight * (1 - y)
    yes, no = yes / max(yes.sum(), 1), no / max(no.sum(), 1)
    hard = no
    for step in range(1, rounds + 1):
        s = sample.scores(w) + bias
        if step % 5 == 0:  # of each unflagged text, the window nearest to a mistake counts as much as its rest
            best = np.full(sample.n_texts, -np.inf)
            np.maximum.at(best, sample.owner[no > 0], s[no > 0])
            hard = (no > 0) & (s >= best[sample.owner] - 1e-9)
            hard = hard / max(hard.sum(), 1)
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        d = (0.3 * yes + 0.35 * no + 0.35 * hard) * (p - y)
        g = sample.gradient(d) + 1e-5 * w
        if same:
            s = same.scores(w)
            gap = s[0::2] - s[1::2]
            d2 = np.empty(len(s))
            d2[0::2], d2[1::2] = gap, -gap
            g += same.gradient(d2) * (0.05 / len(gap))
        g = np.append(np.where(trained, g, 0.0), d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return w, bias


class Scorer:
    """Scores texts in batches; scores of words are kept between them."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.words, self.score, self.hashes = Words(), np.empty(0, np.float32), np.empty(0, np.uint64)

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.words.known) > CACHE:
            self.reset()
        flat, lengths, owner = [], [], []
        known, number = self.words.known, self.words.number
        for i, t in enumerate(texts):
            for s in sentences(t) if t else ():
                flat.extend(known[x] if x in known else number(x) for x in s)
                lengths.append(len(s))
                owner.append(i)
        out = np.full(len(texts), -np.inf)
        if flat:
            fresh = self.words.words[len(self.score) :]
            w = self.model.weights
            self.score = np.append(self.score, [w[features(x)].sum() if x else 0.0 for x in fresh])
            self.hashes = np.append(self.hashes, np.array([crc32(x.encode()) for x in fresh], np.uint64))
            ids = np.array(flat, np.int64)
            begin, end, sent = windows(np.array(lengths, np.int64))
            s = _sums(self.score[ids].astype(np.float64), w[pair_slots(self.hashes[ids])].astype(np.float64), begin, end)
            np.maximum.at(out, np.array(owner, np.int64)[sent], s)
        return [0.0 if np.isneginf(x) else float(1 / (1 + np.exp(-np.clip(x + self.model.bias, -30, 30)))) for x in out]


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model for a corpus, from its reviewed texts.  Reviews that
    contradict each other on a text are left out."""
    agreed = labels.where(F.col("flagged").isin(0, 1)).groupBy("doc_id").agg(F.min("flagged").alias("flagged"), F.max("flagged").alias("other")).where("flagged = other")
    agreed = agreed.orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS)  # bounded, so it may be broadcast
    rows = documents.where(F.length(F.btrim("text")) > 0).select("doc_id", "text").join(F.broadcast(agreed), "doc_id").select("text", "flagged").collect()
    return train(sorted((r.text, r.flagged) for r in rows))


def score(documents: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``(keys, score)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer(part.column(len(keys)).to_pylist()), pa.float64())], names=[*keys, "score"])

    return spread(documents.select(*keys, "text")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double")


def rates(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Texts and found texts of every source, and their share."""
    found = F.count(F.when(F.col("score") >= least, 1))
    return scored.groupBy("source").agg(F.count("*").alias("texts"), found.alias("found"), F.round(found / F.count("*"), 6).alias("rate"))
