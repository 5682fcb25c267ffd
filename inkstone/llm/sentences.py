"""Sentence units across languages and scripts (problem 4), after Kiss and Strunk's Punkt.

One pass over all documents counts, per language, how often each word type stands with and without
a period, which types follow sure sentence ends, how types are written inside sentences, and which
types stand on both sides of a period. Log-likelihood ratios over these counts give each language's
abbreviations, sentence starters and collocations. A second pass takes each text apart into layout
blocks (paragraphs, headings, list entries; wrapped lines are joined) and classifies every possible
end inside a block with these statistics; scripts without periods or spaces have their own marks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.session import cut

ABBREVIATION_SCORE, STARTER_SCORE, COLLOCATION_SCORE = 0.3, 30.0, 7.88
#: Entries of all models together that the driver reads; more is an error, not a cut. Only what was accepted is read, statistics of all types stay in the cluster.
MOST_LEARNED = 5_000_000
#: How often a word has to go on after quoted questions, and how much more often than it begins sentences, to be one of speech.
SPEECH_COUNT, SPEECH_RATIO = 5, 4.0
#: Distinct counts a worker holds before it hands them on; a bound on memory, sums do not change.
FLUSH = 200_000

# fixed values: frequent function words that tell the languages of the Latin script apart (none is a word of two of them)
FUNCTION_WORDS = {
    "en": "the of and to is that it a not with for are by this be from which or has have as at before".split(),
    "de": "der die das und ist nicht ein eine den dem von zu wie sich auf mit als wenn wo hier dass im ohne bei".split(),
    "fr": "le la les est que qui et dans une un du pas pour ce ne plus sur ou au se par il".split(),
}
WORD_LANGUAGE: dict[str, str] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words:
        WORD_LANGUAGE.setdefault(_word, _language)

BLANK = " \t   -​  　⁠﻿"
LINE_BREAK = re.compile("\r\n|[\n\r  \x0b\x0c\x85]")
STRIP = "".join(chr(c) for c in range(0x2000, 0x200C)) + " \t\n\r\x0b\x0c\x85      　⁠﻿"
LIST_MARK = re.compile(rf"(?:[(（]?(?:\d{{1,3}}|[a-zA-Z]|[ivxlIVXL]{{1,5}})[)）]|\d{{1,3}}[.、]|[-–—•*·‣◦▪○●])[{BLANK}]+(?=\S)|[①-⑳]")
HEADING_NUMBER = re.compile(rf"[^\W\d]+[{BLANK}]+(?:\d+|[IVXLCDM]+)[.:][{BLANK}]+\S")
CJK_NUMBER = re.compile("第[0-9一二三四五六七八九十百千]+[章節节部編编回篇卷]$")
CLOSERS = "\"'”’»›」』】）)\\]〉》"
NOTE = r"(?:\[\d{1,4}\]|[¹²³⁰-⁹]+|[†‡*]+(?!\w))"
#: A run of end marks with the closers and note marks behind it.
END = re.compile(rf"(?:[.!?。！？｡．؟।॥|]|…|\.\.\.)+(?:{NOTE}|[{CLOSERS}]|[{BLANK}]+(?=[»”]))*")
TOKEN = re.compile(r"[^\s]+")
LETTERS = re.compile(r"[^\W_]")
#: Longest line of a wrapped text, and the parts of it from which a line counts as full, alone or with the next word.
ENDLESS = re.compile(r"[!-~]{40}")
MOST_WRAPPED, FULL_LINE, FILLED_LINE = 120, 0.7, 0.82
OPEN, CLOSE = "(（[“„«‹「『【《", ")）]”»›」』】》"
PAIR = {")": "(", "）": "（", "]": "[", "”": "“„", "“": "„", "»": "«", "›": "‹", "」": "「", "』": "『", "】": "【", "》": "《"}
MARK = re.compile(f"[{re.escape(OPEN + CLOSE)}\"]")
THAI, DEVANAGARI, KANA, HAN = "฀-๿", "ऀ-ॿ", "぀-ヿ", "一-鿿㐀-䶿"
SCRIPTS = [("th", re.compile(f"[{THAI}]")), ("hi", re.compile(f"[{DEVANAGARI}]")), ("ja", re.compile(f"[{KANA}]")), ("zh", re.compile(f"[{HAN}]"))]
ANY_SCRIPT = re.compile(f"[{THAI}{DEVANAGARI}{KANA}{HAN}]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
# fixed values: common verbs (in Hindi the mark of the speaker, in Japanese that of speech) with which a sentence goes on after a quotation; others are learned
SPEECH_VERBS = r"(?:と(?:[^、。]|$)|[A-Za-z]{{2,20}}\s*(?:问|問|说|說|道|答|喊)|[{han}]{{1,4}}?(?:问|問|说|說|道|答|喊)(?=[，。,.])|[A-Za-z]{{2,20}}\s*(?:ถาม|กล่าว)|\S{{2,20}}\s+ने\s)"
SPEECH_AFTER = re.compile(rf"\s*{SPEECH_VERBS.format(han='一-鿿')}")
#: A quoted question or exclamation, and an end without quotation; then who speaks, if in Latin letters, and the first characters after.
QUOTED_LEAD = re.compile(rf"[!?！？][”」』\"]\s*([A-Za-z]{{2,20}}\s*)?([{THAI}{DEVANAGARI}{KANA}{HAN}]{{1,4}})")
PLAIN_LEAD = re.compile(rf"[.!?。！？।|]\s*([A-Za-z]{{2,20}}\s*)?([{THAI}{DEVANAGARI}{KANA}{HAN}]{{1,4}})")
#: Characters of a lead that tell a word, by language.
LEAD = {"zh": 1, "ja": 1, "th": 4, "hi": 2}


def lead_of(lang: str, m: re.Match) -> str:
    return ("+" if m.group(1) else "") + m.group(2)[: LEAD[lang]]


def language(text: str) -> str:
    """The language by script and, for the Latin script, by function words; 'xx' when nothing tells."""
    best = "xx"
    if not text.isascii() and ANY_SCRIPT.search(text):
        most = len(LATIN.findall(text)) / 3
        counts = {name: len(p.findall(text)) for name, p in SCRIPTS}
        if counts["ja"] > 0.1 * counts["zh"]:
            counts["ja"] += counts["zh"]
        for name, n in counts.items():
            if n > most:
                best, most = name, n
    if best != "xx":
        return best
    found: dict[str, int] = {}
    for w in text.lower().split():
        lang = WORD_LANGUAGE.get(w)
        if lang:
            found[lang] = found.get(lang, 0) + 1
    return max(sorted(found), key=found.__getitem__) if found else "xx"


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Spans that a unit cannot leave, and whether each is a list entry.

    A blank line ends a block; so does a line break before a list mark, and one after a line that had
    room for the next word, as a wrapped line would not have left it.
    """
    lines, at = [], 0
    for m in LINE_BREAK.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    spans = []
    for a, b in lines:
        while a < b and text[a] in STRIP:
            a += 1
        while b > a and text[b - 1] in STRIP:
            b -= 1
        spans.append((a, b))
    # a line with an endless token says nothing about where lines are broken
    width = max((b - a for a, b in spans if b - a <= MOST_WRAPPED or not ENDLESS.search(text, a, b)), default=0)
    wrapped = width <= MOST_WRAPPED and any(wraps(text, spans[k], spans[k + 1]) for k in range(len(spans) - 1))
    start = None
    for k, (a, b) in enumerate(spans):
        if a == b:
            continue
        if start is None:
            start, listed = a, bool(LIST_MARK.match(text, a))
        after = spans[k + 1] if k + 1 < len(spans) else (0, 0)
        if wrapped and after[0] < after[1] and not LIST_MARK.match(text, after[0]):
            word = TOKEN.match(text, after[0])
            first = min(word.end(), after[1]) - after[0]
            if first > 12 and any(p.match(text[after[0]]) for _, p in SCRIPTS):
                first = 2  # a script that wraps anywhere
            if b - a >= FULL_LINE * width or b - a + 1 + first >= FILLED_LINE * width:
                continue
        yield start, b, listed
        start = None


def wraps(text: str, line: tuple[int, int], after: tuple[int, int]) -> bool:
    """Whether a sentence visibly goes on from one line to the next."""
    if line[0] == line[1] or after[0] == after[1] or text[line[1] - 1] in ".!?:;。！？…|।॥”“»」":
        return False
    first = text[after[0]]
    return first.islower() or any(p.match(first) for _, p in SCRIPTS)


@dataclass
class Model:
    """What was learned of one language."""

    abbreviations: dict[str, float] = field(default_factory=dict)  # type -> share of capitalised names after it
    starters: set[str] = field(default_factory=set)
    common: set[str] = field(default_factory=set)  # types written small inside sentences
    collocations: set[tuple[str, str]] = field(default_factory=set)
    speech: set[str] = field(default_factory=set)  # types, or leads in scripts without capitals, that go on after quoted questions


def speech_goes_on(text: str, at: int, lang: str, model: "Model") -> bool:
    """Whether a sentence goes on behind a quotation that ends at ``at``, in scripts without capitals."""
    if SPEECH_AFTER.match(text, at):
        return True
    m = _AFTER.match(text, at)
    return bool(m) and lang in LEAD and lead_of(lang, m) in model.speech


_AFTER = re.compile(rf"\s*([A-Za-z]{{2,20}}\s*)?([{THAI}{DEVANAGARI}{KANA}{HAN}]{{1,4}})")


def bare(token: str) -> str:
    """A token's type: lower case, without surrounding marks; numbers share one type."""
    word = token.strip("\"'“”„«»‹›‘’()[]{}「」『』，,;:!?…—–*").lower()
    return re.sub(r"\d+", "#", word)


def written_small(text: str) -> bool:
    """Whether the sentences of the text begin with small letters."""
    after = re.findall(r"(?:[^\W\d_]{4}\.|[!?])[”\"»)]*\s+[\"“„«(]*([^\W\d_])", text)
    small = sum(c != c.upper() for c in after)
    return small > 0.6 * len(after) if len(after) > 1 else not any(c.isupper() for c in text)


#: Distinct tokens whose analysis a worker remembers.
MEMO = 200_000
_ANALYSED: dict[str, tuple] = {}


def analyse(token: str) -> tuple:
    """``(type, has a period, small or capital, type without period, next is sure, next is a start)`` of a token, remembered."""
    known = _ANALYSED.get(token)
    if known is None:
        if len(_ANALYSED) > MEMO:
            _ANALYSED.clear()
        closed = token.rstrip("\"'”’»)]")
        word = bare(token)
        stop = closed.endswith(".") and not closed.endswith("..")
        kind = word.rstrip(".")
        first = LETTERS.search(token)
        letter = "" if not first else "small" if first.group(0) == first.group(0).lower() else "capital"
        if not LETTERS.search(kind):
            kind = ""
        sure = not stop and token[-1:] not in ":“„«(\"”"
        fresh = closed[-1:] in ("!", "?", "।", "|") or stop and len(kind) > 5 and "." not in kind
        known = _ANALYSED[token] = (kind, stop, letter, bare(token).rstrip("."), sure, fresh)
    return known


def count_text(text: str, counts: Counter) -> None:
    """Adds what one text tells to ``counts``, keyed ``(kind, language, type, next type)``."""
    lang = language(text)
    lower = written_small(text)
    spaceless = lang in ("zh", "ja", "th")
    if lang in LEAD:
        for kind, pattern in (("said", QUOTED_LEAD), ("told", PLAIN_LEAD)):
            for m in pattern.finditer(text):
                counts[kind, lang, lead_of(lang, m), ""] += 1
    for start, end, listed in blocks(text):
        body = LIST_MARK.sub("", text[start:end], count=1) if listed else text[start:end]
        tokens = body.split()
        if spaceless:
            # runs of a script without spaces are no words; only what stands among them counts
            tokens = [t for t in tokens if t.isascii()]
        fresh, sure = not listed, True
        last = len(tokens) - 1
        for k, token in enumerate(tokens):
            kind, stop, letter, _, next_sure, next_fresh = analyse(token)
            if kind:
                counts["with" if stop else "without", lang, kind, ""] += 1
                if fresh:
                    counts["start", lang, kind, ""] += 1
                elif sure and not lower and letter:
                    counts[letter, lang, kind, ""] += 1
                if stop and k < last and len(kind) <= 8:
                    after = analyse(tokens[k + 1])
                    if after[3]:
                        counts["pair", lang, kind, after[3]] += 1
                        if after[2] and not lower:
                            counts["follow" if after[2] == "small" else "Follow", lang, kind, after[3]] += 1
            if not lower and k < last and token[-1:] in "”»\"" and token[-2:-1] in ("!", "?") and lang not in LEAD:
                # a small letter after a quoted question goes on with who asked it
                after = analyse(tokens[k + 1])
                if after[3] and after[2]:
                    counts["said" if after[2] == "small" else "told", lang, after[3], ""] += 1
            if token.endswith("…") or token.endswith("..."):
                after = analyse(tokens[k + 1])[3] if k < last else ""
                if after:
                    counts["dots", lang, after, ""] += 1
            sure, fresh = next_sure, next_fresh


def log_likelihood(count_a: float, count_b: float, count_ab: float, n: float) -> float:
    """Dunning's ratio as Kiss and Strunk use it for abbreviations: the null rate against 0.99."""
    p1, p2 = min(max(count_b / n, 1e-12), 1 - 1e-12), 0.99
    null = count_ab * math.log(p1) + (count_a - count_ab) * math.log(1 - p1)
    alternative = count_ab * math.log(p2) + (count_a - count_ab) * math.log(1 - p2)
    return -2 * (null - alternative)


def pair_likelihood(count_a: float, count_b: float, count_ab: float, n: float) -> float:
    """Dunning's ratio for two types that stand together."""

    def part(k: float, m: float, p: float) -> float:
        return (k * math.log(p) if k and p > 0 else 0.0) + ((m - k) * math.log(1 - p) if m > k and p < 1 else 0.0)

    p = count_b / n
    p1 = count_ab / count_a if count_a else 0.0
    p2 = (count_b - count_ab) / (n - count_a) if n > count_a else 1.0
    rest = max(count_b - count_ab, 0)
    return -2 * (part(count_ab, count_a, p) + part(rest, n - count_a, p) - part(count_ab, count_a, p1) - part(rest, n - count_a, min(max(p2, 0), 1)))


def abbreviation_score(kind: str, with_period: int, without: int, periods: int, tokens: int) -> float:
    inner = kind.count(".") + 1
    letters = len(kind) - inner + 1
    ratio = log_likelihood(with_period + without, periods, with_period, tokens)
    return ratio * math.exp(-letters) * inner * letters ** (-without if without < 50 else -50)


def learn(documents: DataFrame, text: str = "text") -> dict[str, Model]:
    """Models per language from all texts. Null and blank texts add nothing; repeated rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(zip(*counts, strict=True)) or [[], [], [], []]
            batch = pa.RecordBatch.from_arrays([*[pa.array(k, type=pa.string()) for k in keys], pa.array(list(counts.values()), type=pa.int64())], names=["kind", "lang", "type", "after", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    count_text(t, counts)
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    counted = documents.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "kind string, lang string, type string, after string, n bigint")
    counted = cut(counted.groupBy("kind", "lang", "type", "after").agg(F.sum("n").alias("n")))
    of = lambda *names: [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in names]
    singles = counted.where("after = ''")
    totals = {r["lang"]: r for r in singles.groupBy("lang").agg(*of("with", "without", "start", "said", "told")).collect()}  # one row a language
    kinds = singles.groupBy("lang", "type").agg(*of("with", "without", "start", "small", "capital", "said", "told", "dots"))
    every = {lang: (r["with"], r["with"] + r["without"], r["start"], r["said"], r["told"]) for lang, r in totals.items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"short": [], "starter": [], "common": [], "speech": []}
            for lang, kind, stops, plain, starts, small, capital, said, told, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                periods, tokens, all_starts, all_said, all_told = every[lang]
                seen = stops + plain
                out["short"].append(bool(stops) and (len(kind) > 1 or kind.isascii()) and len(kind.replace(".", "")) <= 8 and "#" not in kind and abbreviation_score(kind, stops, plain, periods, tokens) >= ABBREVIATION_SCORE)
                out["starter"].append(bool(starts) and starts / all_starts > seen / tokens and pair_likelihood(all_starts, seen, starts, tokens) >= STARTER_SCORE)
                out["common"].append(small > 10 * capital)
                out["speech"].append(said >= SPEECH_COUNT and said / all_said >= SPEECH_RATIO * told / max(1, all_told))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(9), *[pa.array(v, pa.bool_()) for v in out.values()]], names=["lang", "type", "with", "without", "dots", *out])

    flags = cut(kinds.mapInArrow(judge, "lang string, type string, with bigint, without bigint, dots bigint, short boolean, starter boolean, common boolean, speech boolean"))
    common = flags.where("common").select("lang", F.col("type").alias("after"), F.lit(True).alias("common"))
    short = flags.where("short").select("lang", "type")
    # what follows the candidates: small letters or numbers, names, or words that are common inside sentences
    follow = counted.where(F.col("kind").isin("follow", "Follow")).join(short, ["lang", "type"], "left_semi").join(common, ["lang", "after"], "left")
    inside = (F.col("kind") == "follow") | F.col("after").contains("#")
    name = ~inside & F.col("common").isNull()
    followed = follow.groupBy("lang", "type").agg(F.sum("n").alias("n"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("small"), F.sum(F.when(name, F.col("n")).otherwise(0)).alias("names"))
    judged = short.join(followed, ["lang", "type"], "left").select("lang", "type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("small", F.lit(0)).alias("small"), F.coalesce("names", F.lit(0)).alias("names"))
    # words that only ever end sentences look like abbreviations to the ratio, but not by what follows them
    kept = cut(judged.where("n = 0 OR small >= 0.05 * n OR names >= 0.85 * n").select("lang", "type", F.when(F.col("n") > 0, F.col("names") / F.col("n")).otherwise(0.0).alias("share")))
    single = (F.length("type") == 1) | F.col("type").contains(".") | F.col("type").contains("#")
    pairs = counted.where("kind = 'pair' AND n > 1")
    pairs = pairs.where(single).unionByName(pairs.where(~single).join(kept, ["lang", "type"], "left_semi"))
    first = flags.select("lang", "type", F.col("with").alias("stops"))
    second = flags.where("NOT starter").select("lang", F.col("type").alias("after"), (F.col("with") + F.col("without")).alias("seen"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _, n, stops, seen = (c.to_pylist() for c in batch.columns)
            yield batch.filter(pa.array([pair_likelihood(a, b, k, every[x][1]) >= COLLOCATION_SCORE for x, k, a, b in zip(lang, n, stops, seen, strict=True)], pa.bool_())).select(["lang", "type", "after"])

    sides = pairs.join(first, ["lang", "type"]).join(second, ["lang", "after"]).select("lang", "type", "after", "n", "stops", "seen")
    collocations = sides.mapInArrow(together, "lang string, type string, after string")
    # of the words common inside sentences those that stand where they decide: after abbreviations, initials and dots, or among the starters
    asked = counted.where("kind = 'pair'").where(single).select("lang", "after").unionByName(counted.where("kind = 'pair'").join(kept, ["lang", "type"], "left_semi").select("lang", "after")).unionByName(flags.where("dots > 0 OR starter").select("lang", F.col("type").alias("after")))
    needed = common.join(asked.distinct(), ["lang", "after"], "left_semi")
    plain = lambda df, what, kind="type": df.select(F.lit(what).alias("what"), "lang", F.col(kind).alias("type"), F.lit(None).cast("string").alias("after"), F.lit(0.0).alias("share"))
    learned = plain(flags.where("starter"), "starter").unionByName(plain(flags.where("speech"), "speech")).unionByName(plain(needed, "common", "after")).unionByName(kept.select(F.lit("short").alias("what"), "lang", "type", F.lit(None).cast("string").alias("after"), "share")).unionByName(collocations.select(F.lit("pair").alias("what"), "lang", "type", "after", F.lit(0.0).alias("share")))
    rows = learned.limit(MOST_LEARNED + 1).toArrow()
    if rows.num_rows > MOST_LEARNED:
        raise ValueError("more was learned of the languages than the driver may hold")
    models = {lang: Model() for lang in totals}
    for what, lang, kind, after, share in zip(*(rows.column(c).to_pylist() for c in ("what", "lang", "type", "after", "share")), strict=True):
        model = models[lang]
        if what == "short":
            model.abbreviations[kind] = share
        elif what == "pair":
            model.collocations.add((kind, after))
        else:
            {"starter": model.starters, "common": model.common, "speech": model.speech}[what].add(kind)
    return models


def units(text: str, models: dict[str, Model]) -> list[tuple[int, int]]:
    """Start and end offsets of the sentence units of one text, blanks excluded."""
    if not text or not text.strip(STRIP):
        return []
    lang = language(text)
    model = models.get(lang) or models.get("en") or Model()
    lower = lang in FUNCTION_WORDS and written_small(text)
    out = []
    for start, end, listed in blocks(text):
        cuts = [] if listed else inner_ends(text, start, end, lang, model, lower)
        a = start
        for b in [*cuts, end]:
            while a < b and text[a] in STRIP:
                a += 1
            z = b
            while z > a and text[z - 1] in STRIP:
                z -= 1
            if z > a:
                out.append((a, z))
            a = b
    return out


def inner_ends(text: str, start: int, end: int, lang: str, model: Model, lower: bool) -> list[int]:
    """Offsets inside a block at which a sentence ends."""
    if text[end - 1] not in ".!?。！？…।|॥”“»」』\"')）]" and end - start < 90 and HEADING_NUMBER.match(text, start, end):
        return []
    cuts: list[int] = []
    opened: list[str] = []
    at = start
    places = list(END.finditer(text, start, end))
    if lang in ("th", "zh", "ja"):
        gaps = [m for m in re.finditer(rf"[{BLANK}]*[ 　 ][{BLANK}]*", text[start:end])]
        cuts += [start + m.start() for m in gaps if blank_ends(text, start, start + m.start(), start + m.end(), end, lang, model)]
    for m in places:
        for mark in MARK.finditer(text, at, m.end()):
            c = mark.group(0)
            if c == "“" and opened and opened[-1] == "„":
                opened.pop()
            elif c in OPEN:
                opened.append(c)
            elif c in CLOSE:
                if opened and opened[-1] in PAIR[c]:
                    opened.pop()
            elif c == '"':
                if opened and opened[-1] == '"':
                    opened.pop()
                else:
                    opened.append('"')
        at = m.end()
        if len(opened) > 0:
            # an opening mark that is never closed in the block holds nothing together
            rest = text[m.end() : end]
            if any(c == '"' and '"' in rest or any(x in rest for x in PAIR if c in PAIR[x]) for c in opened):
                continue
            opened.clear()
        if at < end and ends_here(text, m, start, end, lang, model, lower):
            cuts.append(at)
    return sorted(set(cuts))


def blank_ends(text: str, start: int, a: int, b: int, end: int, lang: str, model: Model) -> bool:
    """Whether the blanks at ``a`` to ``b`` part two sentences of a script without periods."""
    if a <= start or b >= end:
        return False
    before, after = text[a - 1], text[b]
    inside = text[start:a]
    if any(inside.count(o) > inside.count(c) for o, c in (("“", "”"), ("「", "」"), ("(", ")"), ("（", "）"), ("『", "』"))):
        return False
    if lang == "th":
        if before.isdigit() or after.isdigit() or before in ",;:–—-" or after in ",;:–—-%ฯๆ(（":
            return False
        return bool(re.match(f"[{THAI}”\"’)]", before)) and bool(re.match(f"[{THAI}“\"A-Za-z]", after)) and not (before == "”" and speech_goes_on(text, b, lang, model))
    wide = rf"[{HAN}{KANA}」』”）]"
    return bool(re.match(wide, before)) and bool(re.match(rf"[{HAN}{KANA}「『“A-Za-z0-9]", after)) and not CJK_NUMBER.search(inside) and not (before in "」”" and speech_goes_on(text, b, lang, model))


def ends_here(text: str, m: re.Match, start: int, end: int, lang: str, model: Model, lower: bool) -> bool:
    """Whether the end marks of ``m`` end a sentence; brackets and quotes are closed here."""
    marks = re.match(r"(?:[.!?。！？｡．؟।॥|]|…)+", m.group(0)).group(0)
    closed = m.group(0)[len(marks) :].strip(STRIP)
    quoted = any(c in "”“»›」』\"'’)）" for c in closed)
    b = m.end()
    while b < end and text[b] in STRIP:
        b += 1
    gap = b > m.end()
    if b >= end:
        return True
    after = text[b]
    if after in ",;:，；、：":
        return False
    if lang in ("zh", "ja"):
        if marks[0] in "。！？｡．!?":
            return not (quoted and speech_goes_on(text, b, lang, model))
        return False if "…" in marks else marks[0] == "." and gap and not text[m.start() - 1].isalnum()
    if "|" in marks or "।" in marks or "॥" in marks:
        return bool(re.search(f"[{DEVANAGARI}0-9”\"')]", text[max(start, m.start() - 2) : m.start()])) and not (quoted and speech_goes_on(text, b, lang, model))
    token = TOKEN.match(text, b)
    following = bare(token.group(0)) if token else ""
    following = following.rstrip(".")
    opening = after in "“„«‹\"'‘([¿¡「"
    letter = LETTERS.search(text, b, min(end, b + 12))
    first = letter.group(0) if letter else after
    small = first != first.upper()
    if "…" in marks or marks.startswith(".."):
        return not small and (following in model.common or following in model.starters) if not lower else following in model.starters
    if "!" in marks or "?" in marks:
        if quoted:
            if speech_goes_on(text, b, lang, model):
                return False
            return not small or lower and following in model.starters and following not in model.speech
        return gap or not small
    # a period
    word_start = m.start()
    while word_start > start and not text[word_start - 1].isspace():
        word_start -= 1
    kind = bare(text[word_start : m.start()]).rstrip(".")
    if not kind:
        return gap and not small
    if closed and quoted:
        return not small or lower and following in model.starters
    if not gap and not closed:
        # no blank behind the period: part of a number, an abbreviation or a name, or a lost blank
        if after.isdigit() or not (after.isalpha() or opening):
            return False
        known = len(kind) > 2 and "." not in kind and kind not in model.abbreviations and not text[m.start() - 1].isdigit()
        return known and (after.isupper() or opening or lower)
    if lang in ("th",):
        return False
    if kind == "#" or re.fullmatch(r"[#.,–-]+", kind):
        if (kind, following) in model.collocations and following not in model.starters:
            return False
        if lang == "de":
            return following in model.starters and following in model.common
        return not small or lower and following in model.starters
    single = len(kind) == 1 and kind.isascii()
    if single or kind in model.abbreviations or "." in kind:
        if not lower and small or after.isdigit():
            return False
        if single and (text[m.start() - 1].isupper() or lower):
            # an initial; in small letters it cannot be told from an abbreviation, so only a common word begins anew
            return lower and following in model.starters and following in model.common
        names = model.abbreviations.get(kind, 1.0 if single else 0.0)
        if names >= 0.5:
            return False
        if lower:
            return following in model.starters and (kind, following) not in model.collocations
        return following in model.common or not small and (kind, following) not in model.collocations
    if lower:
        return True
    return not small


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", models: dict[str, Model] | None = None) -> DataFrame:
    """``key, start_pos, end_pos, unit``: the ordered sentence units of every text, offsets in code points.

    Null and blank texts have none; null keys are kept, repeated rows give repeated units, further
    columns are not read. The models are learned from all rows of ``df`` unless given. Texts of any
    length are taken whole.
    """
    source = df.select(key, text)
    learned = learn(source, text) if models is None else models
    shared = df.sparkSession.sparkContext.broadcast(learned)
    fields = [T.StructField(c, T.IntegerType()) for c in ("unit", "start_pos", "end_pos")]
    schema = T.StructType([source.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            owner, number, starts, ends = [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(units(t, models) if t else ()):
                    owner.append(row)
                    number.append(k)
                    starts.append(a)
                    ends.append(b)
            columns = [batch.column(0).take(pa.array(owner, type=pa.int64())), *[pa.array(x, type=pa.int32()) for x in (number, starts, ends)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
