"""Problem 3: repair text that was read from scanned pages.

1. ``vocabulary`` counts the words of all sections.
2. ``corrections`` relates rare words to frequent ones they may be misread
   from, in SQL: a word's anagram hash is the sum of its characters' hashes,
   so replacing ``wrong`` by ``right`` moves it by a known difference, whatever
   the place; rare words, moved by the difference of each confusion whose
   ``wrong`` they hold, are joined to frequent words on the hash, then compared
   for real and ranked by frequency.
3. ``observed`` reads each section once and gives what may be a trace: lines
   that may be running lines or page numbers, words cut at line ends, and
   words that are not known to be right.
4. ``traces`` decides: page numbers by notation and value, running lines by
   the file's title or by repetition, both in a form in which confusable
   characters are alike; cut words by whether the vocabulary has the joined or
   the hyphenated word; misread words by their correction.
5. ``repaired`` applies the decisions and joins lines to paragraphs.

Defined results: null and blank contents have no trace and stay as they are;
exact duplicate rows count once; two different contents under one key share
their traces; sections of files known not to be PDF, and slides, have none;
sections without a file are judged without its title; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.batches import spread
from foliant.session import materialize

# Characters that scanning software takes for one another.
CONFUSED = (
    "c:e e:c o:a a:o l:i i:l f:t t:f b:h h:b y:v v:y ri:n n:ri rn:m m:rn ii:u u:ii cl:d d:cl n:u u:n li:h h:li vv:w q:g g:q "
    "s:a j:i r:f è:ê ê:è é:ê ã:ă ă:ã â:ã ô:ò ò:ô ó:ô ơ:ó ớ:ó ư:u u:ư ũ:ù ĩ:i ì:i ỉ:i í:i à:á á:à ạ:a ẹ:e ọ:o ụ:u ị:i đ:d ð:đ "
    "ò:ộ ô.:ộ ê.:ệ â.:ậ ć:é ii:ü ö:ó ä:á"
)
# Signs that stand for letters when they occur within words.
SIGNS = "€:e ¢:c §:s ¥:y †:t ¡:i @:a 0:o 3:e 9:g 6:b 4:a 5:s 8:b $:s £:e µ:u ¤:o ®:o ©:c"
_SIGN = {a: b for a, b in (x.split(":") for x in SIGNS.split())}
_HARD = set("€¢§¥†¡@|$£µ¤®©^")
HYPHENS = "-‐‑¬­"
_STRIP = ".,;:!?()[]{}\"'`´«»„“”‚‘’…—–*•·~/\\<>=+&#%"
_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"^\s*(?:def |class |import |from |return|if .*:|for .*:|while .*:)|^\s{2,}\S.*[()\[\]=]|[{};]\s*$|^\s*\||_\w*\d|\w\[\d")
_ROW = re.compile(r"^\s*\|(?:\s|$|.*\|\s*$)")
_SENTENCE = re.compile(r"(?:^|\s)[\"'(«„“]?(?:[^\W\d_]+[,;:]?\s+){3}[^\W\d_]+")
_EVIDENCE = re.compile(r"[()\[\]{}=<>]|_\w*\d")
_IMPORT = re.compile(r"^\s*from [\w.]+ import [\w*]+(?: as \w+)?(?:, \w+(?: as \w+)?)*\s*$")
_ENDS = re.compile(rf"([^\W\d_][^\s]*?)([{HYPHENS}])[ \t\r]*$")
_NUMBERED = re.compile(r"^\s*(?:[-*•‣–]|\d{1,3}[.)])\s")
_WORDS_FOR_PAGE = r"(?:page|p|pg|pp|trang|tr|seite|s|blatt|pagina)"
_PAGE = re.compile(
    rf"(?i)^(?P<pre>[\W_]*)(?P<word>{_WORDS_FOR_PAGE}\b\.?)?[\s.:]*(?P<n>[0-9lioszbg|!]{{1,4}}|[ivxlc]{{1,7}})(?P<of>\s*(?:/|of|sur|von|de|trên)\s*[0-9lio]{{1,4}})?(?P<post>[\W_]*)$"
)
_MISREAD_DIGITS = str.maketrans("lIi|!oOsSzZbBg", "11111005522889")
# Words by which the name of an institution begins.
INSTITUTION = "khoa bộ_môn trường đại_học học_viện viện faculty school department university institute college faculté école département université institut fakultät abteilung lehrstuhl fachbereich universität hochschule fachschule schule akademie"
#: Most frequent words that need no second look: a bound on what is broadcast.
KNOWN_WORDS = 30_000
#: Characters from which a token must be letters for the most part to be a word: not an address or a key.
LONG = 25


def parts_of(token: str) -> list[str]:
    """The words of a token, composed and in lower case: between apostrophes,
    and if hyphenated both the whole and its parts."""
    t = unicodedata.normalize("NFC", token).strip(_STRIP).lower()
    if not t or not _LETTER.search(t):
        return []
    out = []
    for w in re.split(r"['’]", t):
        if len(w) > LONG and sum(c.isalpha() or c == "-" for c in w) < 0.85 * len(w) or "_" in w and "|_" not in w or not _LETTER.search(w):
            continue
        out.append(w)
        if "-" in w.strip("-"):
            out.extend(x for x in w.split("-") if _LETTER.search(x))
    return out


def decoded(word: str) -> list[str]:
    """Readings of a word with signs or digits in it; none for other words."""
    w = word.replace("|1", "n").replace("|_", "u").replace("|n", "h")
    if "^" in w:
        w = unicodedata.normalize("NFC", re.sub(r"(.)\^", lambda m: unicodedata.normalize("NFD", m.group(1))[:1] + "̂" + unicodedata.normalize("NFD", m.group(1))[1:], w))
    w = "".join(_SIGN.get(c, c) for c in w)
    out = {w.replace("1", a).replace("|", a).replace("!", a) for a in "li"}
    return sorted(x for x in out if x != word and not re.search(r"[\d|]", x))


def odd(word: str) -> bool:
    """Does a sign stand where only a letter can?"""
    letters = sum(c.isalpha() for c in word)
    if letters < 3 or "@" in word and "." in word:
        return False
    return any(c in _HARD for c in word) or bool(re.search(r"[^\W\d_][0-9][^\W\d_]", word)) and letters >= 2 * (len(word) - letters) and "_" not in word


def code_lines(lines: list[str], kind: str | None = None) -> set[int]:
    """Which lines are code or rows of tables.  A keyword or ``;`` is not
    enough, for prose has them too: it takes brackets or operators and no
    sentence, a section of code, or code in the next line; a line that reads
    like a sentence must be indented or open an indented block as well."""
    likely = [i for i, line in enumerate(lines) if _CODE.search(line)]
    if not likely or kind == "code":
        return set(likely)
    sure = {i for i in likely if _ROW.match(lines[i]) or _IMPORT.match(lines[i]) or not _SENTENCE.search(lines[i]) and _EVIDENCE.search(lines[i])}
    indent = lambda line: len(line) - len(line.lstrip())
    for order in (likely, reversed(likely)):
        for i in order:
            if i in sure or not {i - 1, i + 1} & sure:
                continue
            after = lines[i + 1] if i + 1 < len(lines) else ""
            if not _SENTENCE.search(lines[i]) or indent(lines[i]) >= 2 or lines[i].rstrip().endswith(":") and indent(after) > indent(lines[i]):
                sure.add(i)
    return sure


_FOLD = {
    **dict.fromkeys("li1!|¡tf†rj", "i"), **dict.fromkeys("nu", "ii"), "m": "iii", "w": "vv", **dict.fromkeys("vy¥", "v"), "d": "oi",
    **dict.fromkeys("hb68", "b"), **dict.fromkeys("ec3€¢oa0@4", "o"), **dict.fromkeys("s5§$", "s"), **dict.fromkeys("g9q", "g"),
    **{c: c for c in "kpxz"},
}


def folded(text: str) -> str:
    """A form in which confusable characters and marks make no difference.
    Numbers standing alone and everything that is no letter leave."""
    t = unicodedata.normalize("NFKD", text.replace("|_", "u")).lower().replace("đ", "d")
    words = [w for w in t.split() if not re.fullmatch(r"[\W_]*\d+[\W_]*", w)]
    return "".join(_FOLD.get(c, "") for w in words for c in w)


def number_of(text: str) -> int | None:
    """Value of a page number in digits (misread or not) or Roman numerals."""
    t = text.lower()
    if re.fullmatch(r"[ivxlc]+", t) and not re.fullmatch(r"l+|i", t):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        v = [value[c] for c in t]
        n = sum(-x if i + 1 < len(v) and x < v[i + 1] else x for i, x in enumerate(v))
        return n if roman(n) == t else None
    d = text.translate(_MISREAD_DIGITS)
    return int(d) if d.isdigit() else None


def roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += s * (n // v)
        n %= v
    return out


def page_number(line: str, page: int | None, edge: bool, table: bool) -> bool:
    """Is the line nothing but a page number?  ``edge``: first or last line."""
    s = line.strip()
    if not s or len(s) > 24 and sum(c.isalnum() for c in s) > 16:
        return False
    m = _PAGE.match(s)
    if not m:
        return False
    pre, post = m["pre"].strip(), m["post"].strip()
    values = {number_of(m["n"]), number_of("".join(m["n"].split()))} - {None}
    if m["n"].lower() in ("i", "l", "ii", "ll", "iii"):
        values |= {len(m["n"]), int("1" * len(m["n"]))}
    if not values:
        return False
    plain_digits = m["n"].isdigit()
    fits = page is None or any(abs(v - page) <= 1 for v in values)
    if m["word"] and (plain_digits or fits) and not (post and post in ",;:?!"):
        return len(m["word"]) > 2 or fits
    if m["of"] and plain_digits and m["of"].strip().startswith("/"):
        return fits
    if pre and post and pre[0] in "[(-–—~.|·*<" and post[-1] in "])-–—~.|·*>":
        return fits
    if not pre and post in ("|",) or not post and pre in ("|",):
        return fits
    if pre or post or table:
        return False
    if page is None:
        return edge and plain_digits and int(m["n"]) < 1000
    return page in values or (not edge and plain_digits and int(m["n"]) in (page, page + 1))


def _running_core(line: str) -> str:
    return re.sub(r"^\s*[0-9ivxlIO]{1,5}\s{2,}|\s{2,}[0-9ivxlIO]{1,5}\s*$", "", line).strip()


def may_run(line: str) -> bool:
    """Could the line be a running title?"""
    core = _running_core(line)
    return len(core) >= 8 and core[-1] not in ".;,?!…:" and core[-1] not in HYPHENS and not _NUMBERED.match(core) and "...." not in core and len(core.split()) >= 2 and (
        core[0].isupper() or not core[0].isalpha() or core != line.strip())


def vocabulary(sections: DataFrame) -> DataFrame:
    """``(word, n)`` over the lines of all sections, code left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            raw: Counter = Counter()
            for text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                code = code_lines(lines, kind)
                for i, line in enumerate(lines):
                    if i not in code:
                        raw.update(line.split())
            for token, n in raw.items():
                words = known.get(token)
                if words is None:
                    if len(known) > 300_000:
                        known.clear()
                    words = known[token] = [] if token[-1] in HYPHENS else parts_of(token)
                for w in words:
                    total[w] += n
            if len(total) > 200_000:
                yield flush()
        yield flush()

    counted = spread(sections.where(F.length("content") > 0).select("content", "element_type")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _hash(c) -> F.Column:
    """Anagram hash: sum over the characters, none beyond 2^40."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda a, x: a + F.pmod(F.xxhash64(x), F.lit(1 << 40)))


def corrections(vocab: DataFrame, least: int = 20, ratio: int = 60) -> DataFrame:
    """``(word, right, hard)``: the best correction of each misread word;
    ``hard``: its signs alone prove it.  ``least``: times a word must occur to
    be a correction; ``ratio``: times more often than the misread one."""
    pairs = [x.split(":") for x in CONFUSED.split()]
    table = F.array(*(F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("right"), (_hash(F.lit(b)) - _hash(F.lit(a))).alias("delta")) for a, b in pairs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, r, h) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in [odd(w)] for r in [*decoded(w), w]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "n", "reading", "hard"])

    readings = vocab.select("word", "n").mapInArrow(read, "word string, n bigint, reading string, hard boolean")
    frequent = vocab.where((F.col("n") >= least) & ~F.col("word").rlike("[0-9€¢§¥†¡@|^]")).select(F.col("word").alias("right"), F.col("n").alias("m"), _hash("word").alias("h"))
    # signs decoded give a word that occurs as such
    plain = readings.where("reading <> word").join(
        vocab.where(F.col("n") >= 2).select(F.col("word").alias("reading"), F.col("n").alias("m")), "reading"
    ).where(F.col("m") >= F.col("n") / 2).select("word", F.col("reading").alias("right"), "m", F.lit(True).alias("hard"), F.lit(0).alias("cost"))
    moves = F.explode(F.filter(table, lambda c: F.contains(F.col("reading"), c["wrong"])))
    moved = (
        readings.where(F.length("reading") >= 3)
        .select("word", "n", "reading", "hard", moves.alias("c"))
        .withColumn("h", _hash("reading") + F.col("c.delta"))
    )
    soft = (
        moved.join(frequent, "h")
        .where((F.col("m") >= ratio * F.col("n")) & (F.levenshtein("reading", "right") <= F.greatest(F.length("c.wrong"), F.length("c.right"))))
        .select("word", "right", "m", "hard", F.lit(1).alias("cost"))
    )
    sure = readings.where("hard AND reading = word").select("word", F.col("reading").alias("right"), F.lit(0).cast("long").alias("m"), "hard", F.lit(2).alias("cost"))
    best = Window.partitionBy("word").orderBy("cost", F.desc("m"), "right")
    every = plain.unionByName(soft).unionByName(sure)
    return every.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("word", "right", "hard")


_TYPES = "document_id string, ord int, content_hash bigint, kind string, line int, pos int, a string, b string, c string, flag boolean"


def observed(sections: DataFrame, known: frozenset) -> DataFrame:
    """Possible traces, one row each.  ``kind`` and its columns: ``page``;
    ``run`` (a: folded core, b: core, c: ``short`` if clearly
    shorter than the text or naming a chapter, pos: near an edge, flag: begins like an institution);
    ``cut`` (a: before, b: after, c: hyphen; pos: lines skipped in between);
    ``word`` (a: word, flag: may be a name)."""
    shared = sections.sparkSession.sparkContext.broadcast(known)
    chapters = {folded(x) for x in ("chapter", "chương", "chapitre", "kapitel")}
    institutions = tuple(folded(x.replace("_", " ")) for x in INSTITUTION.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = shared.value
        cache: dict[str, list[str]] = {}

        def unknown(token: str) -> list[str]:
            out = cache.get(token)
            if out is None:
                if len(cache) > 300_000:
                    cache.clear()
                out = cache[token] = [w for w in parts_of(token) if w not in right]
            return out

        for batch in batches:
            rows: list[tuple] = []
            for doc, ord_, text, page, kind, key in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                full = [i for i, s in enumerate(lines) if s.strip()]
                first, last = full[0], full[-1]
                edges = {*full[:2], *full[-2:]}
                width = max(len(lines[i].strip()) for i in full)
                table = kind in ("table", "code")
                skip = set()
                code = code_lines(lines, kind)
                begin, starts = None, True
                for i, line in enumerate(lines):
                    s = line.strip()
                    if not s:
                        starts = True
                        continue
                    if page_number(line, page, i in (first, last), table):
                        rows.append((doc, ord_, key, "page", i, 0, None, None, None, None))
                        skip.add(i)
                        continue
                    if i in code:
                        begin, starts = None, True
                        continue
                    if may_run(line):
                        core = _running_core(line)
                        f = folded(core)
                        head = core.split()[0].strip("–-—:.,")
                        rows.append((doc, ord_, key, "run", i, int(i in edges), f, core, "short" if len(s) <= 0.8 * width or folded(head) in chapters else None, folded(head) in institutions or folded(" ".join(core.split()[:2])) in institutions))
                    tokens = s.split()
                    cut = _ENDS.search(line) if i < last else None
                    for j, token in enumerate(tokens):
                        if j == len(tokens) - 1 and cut or j == 0 and begin:
                            starts = False
                            continue
                        for k, w in enumerate(unknown(token)):
                            rows.append((doc, ord_, key, "word", i, j * 8 + k, w, None, None, not starts and token.lstrip(_STRIP)[:1].isupper()))
                        starts = token[-1] in ".!?:…" or j == 0 and len(token) < 4 and not token[0].isalpha()
                    begin = None
                    if cut:
                        left = line[cut.start(1) : cut.end(1)].split()[-1].lstrip(_STRIP)
                        for far in (1, 2, 3):
                            if i + far < len(lines) and lines[i + far].strip():
                                m = re.match(r"\s*([^\s]+)", lines[i + far])
                                rest = m.group(1).rstrip(_STRIP + HYPHENS)
                                if left and rest and _LETTER.match(rest[0]) or rest[:1] in _HARD:
                                    rows.append((doc, ord_, key, "cut", i, far, left.lower(), rest.lower(), cut.group(2) + line[cut.end(2) :].rstrip("\n"), rest[0].islower()))
                                    begin = far == 1 or begin
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["document_id", "ord", "content_hash", "kind", "line", "pos", "a", "b", "c", "flag"])

    rows = sections.where(F.length(F.btrim("content", F.lit(" \t\r\n"))) > 0).select(
        "document_id", F.col("ord").cast("int"), "content", "page_number", "element_type", F.xxhash64("content"))
    return spread(rows).mapInArrow(run, _TYPES)


def _files(metas: DataFrame) -> DataFrame:
    """``(document_id, pdf, titles)``: at most four folded titles a file."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([folded(t) if t else None for t in b.column(2).to_pylist()], pa.string())], names=["document_id", "pdf", "title"])

    pdf = F.when(F.col("mime_type").isNotNull(), F.contains(F.lower("mime_type"), F.lit("pdf")))
    named = metas.select("document_id", pdf.alias("pdf"), "title").distinct().mapInArrow(fold, "document_id string, pdf boolean, title string")
    return named.groupBy("document_id").agg(F.bool_or("pdf").alias("pdf"), F.min("title").alias("t1"), F.max("title").alias("t2"))


KEY = ["document_id", "ord", "content_hash"]


def decisions(sections: DataFrame, metas: DataFrame) -> DataFrame:
    """Decided traces: key, ``kind``, ``line``, ``pos``, ``a`` (as read), ``b``
    (as repaired)."""
    eligible = sections.where(F.coalesce(F.col("element_type") != "slide", F.lit(True)))
    vocab = materialize(vocabulary(eligible), "vocabulary")
    right = materialize(corrections(vocab), "corrections")
    known = vocab.join(right.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
    seen = observed(eligible, frozenset(r.word for r in known.select("word").collect())).distinct()
    files = _files(metas)
    seen = materialize(
        seen.join(files.withColumn("known_file", F.lit(True)), "document_id", "left").where(F.coalesce("pdf", F.lit(True))), "observed")

    lines = seen.where("kind = 'run'")
    inside = lambda t: F.endswith(F.col("a"), F.col(t)) & (F.length(t) >= 10) & (F.length("a") - F.length(t) <= 26)
    titled = F.coalesce(inside("t1"), F.lit(False)) | F.coalesce(inside("t2"), F.lit(False))
    often = lines.where(F.length("a") >= 12).groupBy("document_id", "a").agg(F.countDistinct("ord", "line").alias("times"))
    widely = lines.where("flag").groupBy("a").agg(F.countDistinct("document_id", "ord").alias("wide"))
    judged = lines.join(often, ["document_id", "a"], "left").join(widely, "a", "left")
    three = F.size(F.split(F.col("b"), r"\s+")) >= 3
    # a file whose title is not known: what its pages repeat at their edges
    untitled = F.col("t1").isNull() & (F.col("times") >= 2) & (F.col("pos") == 1) & (F.col("c") == "short") & three
    runs = judged.where(titled | untitled | (three & F.col("flag") & ((F.coalesce("times", F.lit(0)) >= 2) | (F.coalesce("wide", F.lit(0)) >= 2))) | (three & (F.col("times") >= 3) & (F.col("pos") == 1) & (F.col("c") == "short")))
    gone = materialize(
        seen.where("kind = 'page'").select(*KEY, F.lit("page_number").alias("kind"), "line").unionByName(runs.select(*KEY, F.lit("running_line").alias("kind"), "line")).distinct(), "lines")

    # cut words: the first following line that stays
    dropped = gone.select(*KEY, F.col("line").alias("gone_line")).distinct()
    cuts = seen.where("kind = 'cut'")
    between = cuts.withColumn("between", F.explode(F.sequence(F.lit(1), F.col("pos")))).withColumn("gone_line", F.col("line") + F.col("between"))
    marked = between.join(dropped.withColumn("is_gone", F.lit(1)), [*KEY, "gone_line"], "left").groupBy(*KEY, "line", "pos", "a", "b", "c", "flag").agg(
        F.sum(F.when(F.col("between") < F.col("pos"), F.coalesce("is_gone", F.lit(0)))).alias("gone_before"),
        F.max(F.when(F.col("between") == F.col("pos"), F.coalesce("is_gone", F.lit(0)))).alias("gone_self"))
    follows = marked.where((F.coalesce("gone_before", F.lit(0)) == F.col("pos") - 1) & (F.col("gone_self") == 0))
    follows = follows.join(dropped.withColumnRenamed("gone_line", "line"), [*KEY, "line"], "left_anti")
    n = lambda name, word: vocab.select(F.col("word").alias(word), F.col("n").alias(name))
    prefixes = vocab.where(F.contains("word", F.lit("-"))).groupBy(F.split_part("word", F.lit("-"), F.lit(1)).alias("a_last")).agg(F.sum("n").alias("n_prefix"))
    word_of = lambda c: F.regexp_replace(c, r"^.*['’]", "")
    tail = F.regexp_extract("b", r"^[^\s'’,.;:!?()]+", 0)
    weighed = (
        follows.withColumns({"joined": F.concat(word_of(F.col("a")), tail), "hyphened": F.concat(word_of(F.col("a")), F.lit("-"), tail), "a_last": F.regexp_replace(word_of(F.col("a")), r"^.*-", "")})
        .withColumn("joined_last", F.concat("a_last", tail))
        .join(n("n_joined", "joined"), "joined", "left").join(n("n_hyphened", "hyphened"), "hyphened", "left")
        .join(n("n_last", "joined_last"), "joined_last", "left").join(prefixes, "a_last", "left")
        .join(right.select(F.col("word").alias("joined"), F.col("right").alias("fixed")), "joined", "left")
        .fillna(0, ["n_joined", "n_hyphened", "n_prefix", "n_last"])
    )
    plain = F.col("c") == "-"
    whole = F.greatest("n_joined", "n_last")
    is_cut = (
        F.when(F.col("n_hyphened") > whole, False).when(whole > 0, True).when(F.col("fixed").isNotNull(), True)
        .when(~plain, True).when(F.col("n_prefix") >= 20, False).otherwise(F.col("flag"))
    )
    cut = weighed.withColumn("cut", is_cut)
    broken = cut.where("cut").select(*KEY, F.lit("broken_word").alias("kind"), "line", "pos", "joined", F.coalesce("fixed", "joined").alias("b"))

    words = seen.where("kind = 'word'").select(*KEY, "line", "pos", "a", "flag").join(dropped.withColumnRenamed("gone_line", "line"), [*KEY, "line"], "left_anti")
    misread = words.join(right, words["a"] == right["word"]).where("hard OR NOT flag")
    # the same letters read for another frequent word again and again are a word of their own: once a section
    place = lambda c: F.when(F.col("hard"), F.col(c)).otherwise(F.lit(-2))
    wrong = misread.select(*KEY, F.lit("wrong_char").alias("kind"), "line", "pos", "a", F.col("right").alias("b"), place("line").alias("at_line"), place("pos").alias("at_pos"))
    wrong = wrong.unionByName(broken.where("joined <> b").select(*KEY, F.lit("wrong_char").alias("kind"), "line", F.lit(-1).alias("pos"), F.col("joined").alias("a"), "b", F.lit(-2).alias("at_line"), F.lit(-2).alias("at_pos")))
    none = F.lit(None).cast("string")
    return materialize(
        gone.select(*KEY, "kind", "line", F.lit(0).alias("pos"), none.alias("a"), none.alias("b"))
        .unionByName(broken.select(*KEY, "kind", "line", "pos", F.col("joined").alias("a"), "b")).unionByName(wrong, allowMissingColumns=True), "decisions")


def traces(decided: DataFrame) -> DataFrame:
    """``(document_id, ord, kind)`` once each; misread characters need two words."""
    counted = decided.groupBy("document_id", "ord", "content_hash", "kind").agg(F.countDistinct(F.coalesce("at_line", "line"), F.coalesce("at_pos", "pos"), F.coalesce("a", F.lit(""))).alias("n"))
    return counted.where((F.col("kind") != "wrong_char") | (F.col("n") >= 2)).select("document_id", "ord", "kind").distinct()


def _like(right: str, seen: str) -> str:
    """``right`` in the letter case of ``seen``."""
    if seen.isupper() and len(seen) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


def repair(text: str, found: list[tuple[str, int, int, str | None, str | None]], element_type: str | None = None) -> str:
    """Text with the decisions applied and its lines joined to paragraphs."""
    lines = text.split("\n")
    code = code_lines(lines, element_type)
    gone = {line for kind, line, *_ in found if kind in ("page_number", "running_line")}
    cut = {line for kind, line, *_ in found if kind == "broken_word"}
    words: dict[int, dict[str, str]] = {}
    for kind, line, _, a, b in found:
        if kind == "wrong_char" and a != b:
            words.setdefault(line, {})[a] = b
    out: list[str] = []
    glue = "\n"
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if i in words:
            for a, b in words[i].items():
                line = re.sub(re.escape(a), lambda m, b=b: _like(b, m.group()), line, flags=re.I)
        s = line.strip() if i not in code else line.rstrip()
        if not s:
            glue = "\n\n"
            continue
        if out and (glue == "\n\n" or _NUMBERED.match(s) or i in code):
            out.append("\n\n" if glue == "\n\n" else "\n")
        elif out and glue != "":
            out.append(" " if glue == " " else "\n")
        if i in cut:
            s, glue = _ENDS.sub(lambda m: m.group(1), s), ""
        elif _ENDS.search(s) and not s.endswith(" -"):
            glue = ""  # keeps its hyphen
        else:
            glue = "\n" if i in code else " "
        out.append(s)
    return "".join(out)


def repaired(sections: DataFrame, decided: DataFrame) -> DataFrame:
    """``(document_id, ord, content)`` of the sections that have traces, repaired."""
    notes = decided.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("kind", "line", "pos", "a", "b"))).alias("found"))
    rows = sections.where(F.col("content").isNotNull()).select("document_id", F.col("ord").cast("int"), F.xxhash64("content").alias("content_hash"), "content", "element_type")
    joined = rows.join(notes, KEY).dropDuplicates(KEY).select("document_id", "ord", "content", "found", "element_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [repair(t, [(x["kind"], x["line"], x["pos"], x["a"], x["b"]) for x in f], e) for t, f, e in zip(*(c.to_pylist() for c in b.columns[2:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["document_id", "ord", "content"])

    return joined.mapInArrow(run, "document_id string, ord int, content string")
