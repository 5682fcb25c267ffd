"""Noise in text from scanned pages (problem 6).

A first pass counts the word forms of all pages by language. Forms are grouped by a skeleton in which
glyphs that scanners confuse are one; within a group the forms that are frequent, or known to the
lexicon, are right, and forms far rarer than a right one are misreadings of it. A second pass reads
every page line by line against this dictionary and finds misread, split and run-together words,
words cut at line ends, page numbers, and lines at the edges of pages. The same pass counts the
neighbours of right forms that have doubtful ones in their group; where frequency alone does not
decide, a form is misread if the right form, and not it, is what stands between such neighbours.
Of very many forms the rarer ones are learned in the cluster, in tiers from frequent to rare, and lie in files
that every node has; forms too rare to learn are judged by their true counts in a join. Which edge lines are running
heads shows only over a whole work: their letters, with digits masked, come back on other pages, or
name the work, its author or a section. Paragraphs are then reflowed over line and page ends.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm import rest
from inkstone.llm.sentences import FUNCTION_WORDS
from inkstone.session import cut

#: Forms the dictionaries of all languages hold in memory; where more are seen ``LEAST_COUNT`` times, the rarer ones are looked up in files. No effect on results.
MOST_FORMS = 600_000
#: Words of a lexicon, at most; more is an error.
MOST_WORDS = 2_000_000
LEAST_COUNT = 3
#: How often a right form has to stand between a doubtful one's neighbours.
SUPPORT = 2
#: How much more frequent a right form is than its misreadings, than run-together pairs of it, than torn-off pieces of it.
MISREAD_RATIO, TOGETHER_RATIO, PIECE_RATIO = 8, 30, 100
#: Count from which a form is firm enough to correct others.
FIRM = 20
#: Distinct forms a worker holds before it hands counts on.
FLUSH = 400_000
#: Pages on whose edges a line must come back to be a running head.
HEAD_PAGES = 2
LONGEST_HEAD = 90
#: Letters of a head from which one wrong letter is forgiven.
LEAST_NEAR = 8

# fixed values: glyphs and glyph pairs that scanners take for one another
PAIRS = {"w": "vv", "m": "rn", "d": "cl", "h": "li", "ﬁ": "fi", "ﬂ": "fl", "æ": "ae", "œ": "oe"}
CLASSES = {"i": "i1lrtfjſ!|ıíìî", "c": "ceéèêëç", "o": "0oöô", "n": "nuüûù", "s": "5s", "v": "vy", "a": "aäàâ", "g": "g9", "b": "b6", "z": "z2"}
SKELETON = {ord(x): c for c, group in CLASSES.items() for x in group}
SKELETON |= {ord(k): "".join(SKELETON.get(ord(x), x) for x in v) for k, v in PAIRS.items()}

MARKS = "~^*·|_`¨°•"
CUT_MARKS = "-‐¬­"
TRIM = ".,;:!?()[]{}“”„\"«»‘’'…—–" + CUT_MARKS
LINE_CUT = re.compile(f"[{CUT_MARKS}][ \t]*\n[ \t]*")
APART = re.compile("[-‐–—'’/]")
INSIDE = re.compile(f"[{re.escape(MARKS)}]")
WORD = re.compile(r"[^\W_]+")
ROMAN = "(?=[ivxlIVXL])(?:[xX]{0,3}|[xX][lLcC]|[lL][xX]{0,3})(?:[iI][xX]|[iI][vV]|[vV]?[iI]{0,3})"
NUMBER = rf"(?:[0-9lIOoSſ]*[0-9][0-9lIOoSſ]*|{ROMAN}|[lI]{{1,3}})"
PAGE_NUMBER = re.compile(rf"[\[({{–—\-‐~*·. ]*(?:(?:pages?|pagc|paqe|seite|s\.|p\.|pp\.|pag\.|p|s)\s*)?{NUMBER}(?:\s*(?:of|ot|von|de|sur|/)\s*{NUMBER})?[\])}}–—\-‐~*·. ]*", re.I)
CUT_NUMBER = re.compile(rf"pa[gq][ec]\s+{NUMBER}\s+o[ft]?\s*", re.I)
EDGE_NUMBER = re.compile(rf"^\s*{NUMBER}(?:\s{{2,}}|\s+(?=[A-ZÄÖÜ0-9]))|\s{{2,}}{NUMBER}\s*$")
CHAPTER = re.compile(r"\s*(?:cha[pf]ter|kapitel|chapitre|cha[pf]itre|cbapter|book|buch|livre)\s+[ivxlIVXL1\d]{1,7}\.?\s*$", re.I)


#: Marks that titles do not have.
PROSE = re.compile(r"[;!?“”„,]|[a-zà-ÿ]\. ")


def skeleton(form: str) -> str:
    return form.translate(SKELETON)


def page_language(counts: Counter) -> str:
    """The language of a page by function words; 'en' when nothing tells."""
    best, most = "en", 0
    for name, words in FUNCTION_WORDS.items():
        n = sum(counts.get(w, 0) for w in words)
        if n > most:
            best, most = name, n
    return best


def forms(token: str) -> list[str]:
    """Word forms of a token: lower case, apart at hyphens and apostrophes, without marks around it."""
    return [p for p in (x.strip(TRIM) for x in APART.split(token.strip(TRIM).lower())) if p and not p.isdigit()]


def count_forms(pages: DataFrame, text: str = "text") -> DataFrame:
    """``lang, form, n`` over all pages. Words cut at a line end and tokens with stray marks are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {lang: Counter() for lang in FUNCTION_WORDS}

        def flush() -> pa.RecordBatch:
            rows = [(lang, form, n) for lang, c in totals.items() for form, n in c.items()]
            for c in totals.values():
                c.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.string()), pa.array(columns[1], type=pa.string()), pa.array(columns[2], type=pa.int64())], names=["lang", "form", "n"])

        for batch in batches:
            raw: dict[str, Counter] = {lang: Counter() for lang in FUNCTION_WORDS}
            for t in batch.column(0).to_pylist():
                if t:
                    tokens = LINE_CUT.sub("\x01", t).split()
                    counts = Counter(tokens[1:])
                    raw[page_language(counts)].update(counts)
            for lang, counts in raw.items():
                total = totals[lang]
                for token, n in counts.items():
                    if "\x01" in token or INSIDE.search(token):
                        continue
                    for form in forms(token):
                        total[form] += n
            if sum(map(len, totals.values())) > FLUSH:
                yield flush()
        yield flush()

    counted = pages.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "lang string, form string, n bigint")
    return counted.groupBy("lang", "form").agg(F.sum("n").alias("n"))


class Dictionary:
    """Right forms of a language with their counts, and what the others are."""

    def __init__(self, counts: dict[str, int], lexicon: set[str], held_from: int = LEAST_COUNT):
        self.held: dict[str, int] = {}
        self.right = self.held
        self.best: dict[str, str] = {}
        self.wrong: dict[str, str] = {}
        self.longest: dict[str, int] = {}
        #: The count from which forms are held, and right forms whose neighbours count.
        self.held_from = held_from
        self.mates: frozenset[str] = frozenset()
        self.memo: dict[str, int] = {}
        for form, n in sorted(counts.items(), key=lambda x: (x[0] not in lexicon, -x[1], x[0])):
            known = form in lexicon
            fix = None if known else self.explain(form, n)
            if fix:
                self.wrong[form] = fix
            elif known or self.stands(form, n, self.longest.get(form, 0)):
                self.add(form, n, counts)
        self.longest = {}

    def extend(self, lang: str, forms_in: list[str], best_in: list[str]) -> None:
        """Further forms, all rarer than ``held_from``, and the best of their skeletons are looked up in files."""
        plain = {name: getattr(x, "held", x) for name, x in (("wrong", self.wrong), ("best", self.best))}
        self.right = rest.RightForms(self.held, lang, forms_in)
        self.wrong = rest.WrongForms(plain["wrong"], lang, forms_in)
        self.best = rest.BestForms(plain["best"], lang, best_in, self.held, self.held_from)
        self.memo = {}

    def add(self, form: str, n: int, counts: dict[str, int]) -> None:
        self.right[form] = n
        key = skeleton(form)
        if self.right.get(self.best.get(key, ""), -1) < n:
            self.best[key] = form
        # of its pieces only those are kept that are forms themselves, far rarer ones
        for k in range(1, len(form)):
            for piece in (form[:k], form[k:]):
                if n >= PIECE_RATIO * counts.get(piece, n) and self.longest.get(piece, 0) < n:
                    self.longest[piece] = n

    @staticmethod
    def stands(form: str, n: int, whole: int) -> bool:
        """Whether an unexplained form is a word, and not a piece of a far more frequent one, which was seen ``whole`` times."""
        return whole < PIECE_RATIO * n if len(form) > 1 else n >= 50 * LEAST_COUNT

    def explain(self, form: str, n: int, since: int = 0) -> str | None:
        """The right reading of a rare form: by skeleton, or as two words run together. Forms in files below ``since`` are not yet known."""
        if "ſ" in form:
            modern = form.replace("ſ", "s")
            if self.right.get(modern, 0) >= FIRM and (not since or modern in self.held or self.right[modern] >= since):
                return modern
        other = self.best.get(skeleton(form))
        if other and other != form and len(form) > 1 and self.right[other] >= max(FIRM, MISREAD_RATIO * n):
            # two letters are too few to say, unless one of them is wrong and the right form is very frequent
            if len(form) > 2 or len(other) == 2 and (form[0] == other[0] or form[1] == other[1]) and self.right[other] >= PIECE_RATIO * n:
                return other
        if len(form) > 3:
            least = max(FIRM, TOGETHER_RATIO * n)
            right = self.right if least < self.held_from else self.held
            for k in range(1, len(form)):
                a, b = right.get(form[:k], 0), right.get(form[k:], 0)
                if min(a, b) >= least and (k > 1 or form[0] in "aàyl") and (k < len(form) - 1):
                    return f"{form[:k]} {form[k:]}"
        return None

    def verdict(self, token: str) -> int:
        """0 right, 1 misread, 2 not known, 3 misread if as rare as can be, 4 not known beside a right form of its skeleton, 5 such a right form."""
        v = self.memo.get(token)
        if v is None:
            if len(self.memo) > FLUSH:
                self.memo.clear()
            v = self.memo[token] = self.judge(token)
        return v

    def is_right(self, form: str) -> bool:
        return form in self.right

    def judge(self, token: str) -> int:
        bare = token.strip(TRIM)
        if not bare:
            return 0
        low = bare.lower()
        if not any(c.isalpha() for c in low):
            return 0
        if INSIDE.search(bare):
            whole = INSIDE.sub("", low)
            return 1 if any(c.isalpha() for c in whole) else 0
        parts = [p for p in (x.strip(TRIM) for x in APART.split(low)) if p]
        rare = doubtful = False
        unknown = 0
        for p in parts:
            if p in self.right or p.isdigit() or len(p) == 1 and p.isalpha():
                continue
            # a form that was not learned was seen less than ``LEAST_COUNT`` times
            if p in self.wrong or self.explain(p, LEAST_COUNT - 1):
                return 1
            if self.explain(p, 1):
                rare = True
            elif self.mate(p):
                doubtful = True
            if any(c.isdigit() for c in p) and any(c.isalpha() for c in p):
                continue
            unknown += 1
        if unknown and len(parts) > 1 and ("'" in low or "’" in low):
            whole = re.sub("['’]", "", low)
            if whole in self.right and self.right[whole] >= FIRM:
                return 1
        if len(parts) == 2 and ("'" in low or "’" in low) and "".join(parts) in self.right and self.right["".join(parts)] >= FIRM and not all(p in self.right for p in parts):
            return 1
        return 3 if rare else 4 if doubtful else 2 if unknown else 5 if low in self.mates else 0

    def mate(self, form: str) -> str | None:
        """The right form of a doubtful one's skeleton, where frequency does not decide between them."""
        other = self.best.get(skeleton(form)) if len(form) > 2 else None
        return other if other != form else None

    def doubts(self, token: str, kind: int) -> list[str]:
        """The forms of a token that are too rare (3) or doubtful (4)."""
        parts = [p for p in (x.strip(TRIM) for x in APART.split(token.strip(TRIM).lower())) if p and p not in self.right and not p.isdigit()]
        return [p for p in parts if (self.explain(p, 1) if kind == 3 else not self.explain(p, 1) and self.mate(p))]

    def repair(self, token: str, supported: bool = False) -> str:
        """The token with misread parts put right, its marks and capitals kept; doubtful ones, too, where the line is known to be misread (``supported``)."""
        verdict = self.verdict(token)
        if verdict != 1 and not (supported and verdict in (3, 4)):
            return token
        bare = token.strip(TRIM)
        at = token.index(bare)
        plain = INSIDE.sub("", bare)
        parts = re.split("([-‐–—'’/])", plain)
        fixed = "".join(self.reading(p, supported) for p in parts)
        whole = re.sub("['’]", "", plain)
        if whole != plain and whole.lower() in self.right and not all(p.lower() in self.right for p in parts if p.isalpha()):
            fixed = whole
        return token[:at] + fixed + token[at + len(bare) :]

    def reading(self, part: str, supported: bool = False) -> str:
        low = part.lower()
        if not low or low in self.right:
            return part
        fix = self.wrong.get(low) or self.explain(low, 1 if supported else LEAST_COUNT - 1) or (self.mate(low) if supported else None)
        if not fix:
            return part
        return fix.upper() if part.isupper() and len(part) > 1 else fix[0].upper() + fix[1:] if part[0].isupper() else fix

    def joined(self, a: str, b: str) -> bool:
        """Whether two neighbouring tokens are one right word torn apart."""
        if a[-1:] in TRIM or b[:1] in TRIM:
            return False
        x, y = a.strip(TRIM).lower(), b.strip(TRIM).lower()
        if not x.isalpha() or not WORD.match(y):
            return False
        y = WORD.match(y).group(0)
        n = self.right.get(x + y, 0)
        if n < FIRM:
            # the torn word may be misread as well
            other = self.best.get(skeleton(x + y))
            if not other or self.right[other] < FIRM or (x in self.right and y in self.right):
                return False
            return not (x in self.right and len(x) > 2) and not (y in self.right and len(y) > 2)
        return not (x in self.right and y in self.right)


def plain_form(token: str) -> str:
    return token.strip(TRIM).lower()


def line_cut(d: Dictionary, a: str, b: str, mark: str) -> bool:
    """Whether a word is cut between the ends ``a`` and ``b`` by a mark that is not its own."""
    x, y = a.strip(TRIM).lower(), b.strip(TRIM).lower()
    m = WORD.match(y)
    y = m.group(0) if m else ""
    # of a compound only the last part stands at the line's end
    x = APART.split(x)[-1]
    x = INSIDE.sub("", x)
    if not x or not y:
        return bool(x) and x not in d.right
    if b.strip(TRIM)[:1].isupper() and x[:1].islower() and not a.strip(TRIM).isupper():
        return False
    whole = d.right.get(x + y, 0)
    if whole:
        return True
    both = x in d.right and y in d.right
    if both and d.right[x] >= FIRM and d.right[y] >= FIRM:
        return False
    other = d.best.get(skeleton(x + y))
    if other:
        return True
    if mark in "¬­":
        return not both
    return not both


def head_key(line: str) -> str:
    """What is the same in a running head on all pages: its letters, confusable glyphs as one, numbers masked."""
    text = line.strip()
    for _ in range(2):
        text = EDGE_NUMBER.sub("", text)
    return skeleton("".join(c for c in text.lower() if c.isalpha() or c in "015"))


def is_page_number(line: str) -> bool:
    text = line.strip()
    return bool(text) and len(text) <= 24 and bool(PAGE_NUMBER.fullmatch(text) or CUT_NUMBER.fullmatch(text + " ")) and (any(c.isdigit() for c in text) or bool(re.search("[ivxlIVXLO]", text)))


def edge_lines(lines: list[str]) -> tuple[list[int], set[int], set[int]]:
    """Positions of lines with text, of page numbers, and of headings that open a chapter."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    numbers = {k for k in {*full[:1], *full[-1:]} if is_page_number(lines[k])} if full else set()
    openings: set[int] = set()
    rest = [k for k in full if k not in numbers]
    if rest and CHAPTER.match(lines[rest[0]]):
        openings.add(rest[0])
        if len(rest) > 1 and rest[1] == rest[0] + 1 and (rest[1] + 1 >= len(lines) or not lines[rest[1] + 1].strip()):
            openings.add(rest[1])
    return full, numbers, openings


def may_be_head(line: str) -> bool:
    text = line.strip()
    letters = [c for c in text if c.isalpha()]
    if not 3 <= len(letters) <= LONGEST_HEAD or len(text) > LONGEST_HEAD:
        return False
    if text[-1] in ",;!-¬­‐" or text[-1] == "." and not re.search(r"[IVXLivxl\d]\.$", text):
        return False
    bare = EDGE_NUMBER.sub("", text).strip()
    return bool(bare) and (bare[0].isupper() or bare[0].isdigit() or not bare[0].isalpha())


def read_page(lines: list[str], d: Dictionary, near: Counter | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, str, int]], tuple[int, str, str] | None, tuple[str, str], list[tuple[int, int, list[str]]]]:
    """Kinds that need only this page; edge lines ``(line, key, kinds)``; a word cut at the page's end; the page's first words.

    ``kinds`` of an edge line is 1 if it is misread and 2 if it ends in a cut word, should it be no head. Last come the
    open cases: ``(line, 3, [form])`` for a form whose count decides, of lines that nothing else shows to be misread; ``(line, 4,
    [form, right form, word before, word after])`` for one that its neighbours decide, of all lines, since it is weighed by where
    else it stands. The neighbours of mates go to ``near``.
    """
    full, numbers, openings = edge_lines(lines)
    found = [(k, "page_number") for k in sorted(numbers)]
    body = [k for k in full if k not in numbers and k not in openings]
    edges = {}
    title_page = len(full) <= 4 and not numbers and all(len(lines[k].split()) <= 9 and lines[k].rstrip()[-1] not in ".!?;:,-¬­‐" for k in full) and (any(re.match(r"\s*(?:by|von|par)\s", lines[k]) for k in full) or all(lines[k].strip()[0].isupper() for k in full))
    if body and not title_page:
        for k in {body[0], body[-1]}:
            if may_be_head(lines[k]) and (len(body) > 1 or openings):
                edges[k] = head_key(lines[k])
    # an opening's second line names the section; it is sent on to recognise heads of later pages
    named = [(k, head_key(lines[k]), 4) for k in sorted(openings)[1:]]
    tokens = {k: lines[k].split() for k in body}
    kinds: dict[int, int] = dict.fromkeys(body, 0)
    pending = None
    open_cases: list[tuple[int, int, list[str]]] = []
    for i, k in enumerate(body):
        words = tokens[k]
        skip_first = False
        if i:
            before = body[i - 1]
            skip_first = bool(tokens[before]) and tokens[before][-1][-1] in CUT_MARKS
        bad = False
        doubts: list[tuple[int, int]] = []
        last = len(words) - 1
        for j, w in enumerate(words):
            if j == last and w[-1] in CUT_MARKS or j == 0 and skip_first:
                continue
            v = d.verdict(w)
            if not v:
                continue
            if v == 5:
                if near is not None:
                    form = plain_form(w)
                    if j:
                        near[form, "<" + plain_form(words[j - 1])] += 1
                    if j < last:
                        near[form, ">" + plain_form(words[j + 1])] += 1
                continue
            if v > 2:
                doubts.append((j, v))
            # a misread line is read on: its words are neighbours, too
            bad = bad or v == 1 or j < last and d.joined(w, words[j + 1]) or j > 0 and not (j == 1 and skip_first) and d.joined(words[j - 1], w)
        if bad:
            kinds[k] |= 1
        for j, v in doubts:
            if v == 4 or not bad:
                for form in d.doubts(words[j], v):
                    open_cases.append((k, 3, [form]) if v == 3 else (k, 4, [form, d.mate(form), plain_form(words[j - 1]) if j else "", plain_form(words[j + 1]) if j < last else ""]))
        end = words[-1] if words else ""
        if end and end[-1] in CUT_MARKS and len(end) > 1:
            after = next((n for n in body[i + 1 :] if n not in edges or n != body[-1]), None)
            if after is None:
                pending = (k, end[:-1], end[-1])
            elif tokens[after]:
                start = tokens[after][0]
                if line_cut(d, end[:-1], start, end[-1]):
                    kinds[k] |= 2
                    x, y = APART.split(end[:-1].strip(TRIM).lower())[-1], start.strip(TRIM).lower()
                    if INSIDE.search(x):
                        kinds[k] |= 1
                    elif INSIDE.search(y):
                        kinds[after] |= 1
                    elif x + y not in d.right:
                        other = d.wrong.get(x + y) or d.explain(x + y, LEAST_COUNT - 1)
                        if other:
                            kinds[k if other[: len(x)] != x else after] |= 1
    for k in body:
        if k not in edges:
            if kinds[k] & 1:
                found.append((k, "misread"))
            if kinds[k] & 2:
                found.append((k, "hyphen"))
    at_edge = [(k, key, kinds[k]) for k, key in edges.items()] + named
    first = tokens[body[0]][0] if body and tokens[body[0]] else ""
    later = body[1] if len(body) > 1 and body[0] in edges else body[0] if body else None
    second = tokens[later][0] if later is not None and tokens[later] else ""
    return found, at_edge, pending, (first, second), open_cases


def learn(pages: DataFrame, lexicon: DataFrame) -> tuple[dict[str, Dictionary], DataFrame]:
    """Dictionaries of all languages, and the counts of all forms (``lang, form, n``).

    The driver holds at most ``MOST_FORMS`` forms and the words of the lexicon that occur. Rarer forms are settled in
    the cluster (``learn_rest``) as if they were held as well.
    """
    counted = cut(count_forms(pages))
    words = lexicon.where("lang IS NOT NULL AND word IS NOT NULL").select("lang", F.lower("word").alias("form")).distinct()
    # how often a form has to be seen so that not too many are held
    top = 10_000
    steps = counted.where(F.col("n") >= LEAST_COUNT).groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("forms")).orderBy(F.desc("n")).collect()  # at most 10,000 rows
    floor, held = LEAST_COUNT, 0
    for r in steps:
        held += r["forms"]
        if held > MOST_FORMS:
            floor = r["n"] + 1
            break
    if floor > top:
        raise ValueError(f"more than {MOST_FORMS} forms are seen {top} times")
    known = counted.join(words.withColumn("known", F.lit(True)), ["lang", "form"], "left")
    rows = known.where((F.col("n") >= floor) | F.col("known")).select("lang", "form", "n", F.coalesce("known", F.lit(False)).alias("known")).limit(MOST_FORMS + MOST_WORDS + 1).toArrow()
    if rows.num_rows > MOST_FORMS + MOST_WORDS:
        raise ValueError("the lexicon has too many words")
    counts: dict[str, dict[str, int]] = {lang: {} for lang in FUNCTION_WORDS}
    right: dict[str, set[str]] = {lang: set() for lang in FUNCTION_WORDS}
    for lang, form, n, is_word in zip(*(rows.column(c).to_pylist() for c in ("lang", "form", "n", "known")), strict=True):
        counts[lang][form] = n
        if is_word:
            right[lang].add(form)
    made = {lang: Dictionary(c, right[lang], floor) for lang, c in counts.items()}
    if floor > LEAST_COUNT:
        learn_rest(made, counted, cut(known.where((F.col("n") >= LEAST_COUNT) & (F.col("n") < floor) & F.col("known").isNull()).select("lang", "form", "n")), floor)
    shared = pages.sparkSession.sparkContext.broadcast(made)

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for lang, form, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = shared.value[lang]
                if form not in d.right and form not in d.wrong and not d.explain(form, n) and d.mate(form):
                    found.add((lang, d.mate(form), d.mate(form) in d.held))
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["lang", "key", "held"])

    found = counted.select("lang", "form", "n").mapInArrow(doubtful, "lang string, key string, held boolean").distinct()
    if floor > LEAST_COUNT:
        found = cut(found)
    mates = found.where("held").toArrow()  # right forms that are held
    more = rest.send(found.where("NOT held").select("lang", "key", F.lit(0).alias("n"), F.lit(None).cast("string").alias("text"))) if floor > LEAST_COUNT else None
    for lang, d in made.items():
        held = frozenset(f for x, f in zip(mates.column("lang").to_pylist(), mates.column("key").to_pylist(), strict=True) if x == lang)
        d.mates = rest.SomeForms(held, lang, [more]) if more else held
        d.memo = {}
    return made, counted


def learn_rest(made: dict[str, Dictionary], counted: DataFrame, forms_left: DataFrame, floor: int) -> None:
    """Settles the forms that are seen ``LEAST_COUNT`` times or more but less than ``floor`` times, and lets the dictionaries find them in files.

    Whether a form is right hangs on right forms that are firm and at least ``MISREAD_RATIO`` times as frequent, so
    the forms between a count and that many times it do not hang on one another and are settled together. Only a
    form with a long s hangs on its modern spelling whatever that one's count: those come last in a tier.
    """
    forms_in: list[str] = []
    best_in: list[str] = []
    while floor > LEAST_COUNT:
        least = LEAST_COUNT if floor <= FIRM else max(LEAST_COUNT, -(-floor // MISREAD_RATIO))
        tier = forms_left.where((F.col("n") >= least) & (F.col("n") < floor))
        modern = ~F.col("form").contains("ſ")
        for part in [tier] if floor <= FIRM else [tier.where(modern), tier.where(~modern)]:
            settled = cut(settle(made, counted, part, least))
            # each goes before the others of its skeleton by its count, then by its letters
            first = F.min(F.struct((-F.col("n")).alias("n"), F.col("key").alias("text"))).alias("first")
            best = settled.where("text IS NULL").groupBy("lang", "skeleton").agg(first).select("lang", F.col("skeleton").alias("key"), (-F.col("first.n")).alias("n"), F.col("first.text").alias("text"))
            forms_in.append(rest.send(settled))
            best_in.append(rest.send(best))
            for lang, d in made.items():
                d.extend(lang, [*forms_in], [*best_in])
        floor = least


def settle(made: dict[str, Dictionary], counted: DataFrame, part: DataFrame, least: int) -> DataFrame:
    """``lang, key, n, text, skeleton`` of the right forms of ``part`` (``text`` null) and of the wrong ones (``text`` the right reading)."""
    shared = part.sparkSession.sparkContext.broadcast(made)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, piece, n) for lang, form, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if form in shared.value[lang].right for k in range(1, len(form)) for piece in (form[:k], form[k:])]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["lang", "form", "n"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, form, n, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fix = shared.value[lang].explain(form, n, n)
                if fix or Dictionary.stands(form, n, whole):
                    out.append((lang, form, n, fix, skeleton(form)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 2 else pa.string()) for k, c in enumerate(columns)], names=["lang", "key", "n", "text", "skeleton"])

    frequent = counted.where(F.col("n") >= PIECE_RATIO * least).select("lang", "form", "n").mapInArrow(pieces, "lang string, form string, n bigint")
    whole = frequent.groupBy("lang", "form").agg(F.max("n").alias("whole"))
    asked = part.join(whole, ["lang", "form"], "left").select("lang", "form", "n", F.coalesce("whole", F.lit(0)).cast("bigint").alias("whole"))
    return asked.mapInArrow(judge, "lang string, key string, n bigint, text string, skeleton string")


def read_pages(pages: DataFrame, dictionaries: dict[str, Dictionary]) -> DataFrame:
    """``doc, page, line_no, kind, key, flags, words``: findings and what is still open of every page.

    ``kind`` is a final kind, or ``edge``, ``cut`` (word cut at the page's end), ``first`` (the page's first words), ``rare`` or
    ``doubt`` (forms that the line hangs on; ``flags`` is 1 where it may be a head), or ``near`` (how often a form has a neighbour, over many pages).
    """
    shared = pages.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for number, batch in enumerate(batches):
            near: dict[str, Counter] = {}
            at, line, kind, key, flags, words = [], [], [], [], [], []

            def put(row: int, n: int, what: str, k: str | None = None, f: int = 0, w: list[str] | None = None) -> None:
                at.append(row)
                line.append(n)
                kind.append(what)
                key.append(k)
                flags.append(f)
                words.append(w)

            for row, t in enumerate(batch.column(2).to_pylist()):
                if not t:
                    continue
                lang = page_language(Counter(t.split()))
                lines = t.split("\n")
                found, edges, pending, first, open_cases = read_page(lines, known[lang], near.setdefault(lang, Counter()))
                for n, what in found:
                    put(row, n, what)
                for n, k, f in edges:
                    put(row, n, "edge", k, f, ["prose"] if PROSE.search(lines[n]) else None)
                maybe = {n for n, _, f in edges if f < 4}
                for n, which, forms_of in open_cases:
                    put(row, n, "rare" if which == 3 else "doubt", lang, int(n in maybe), forms_of)
                if pending:
                    put(row, pending[0], "cut", lang, 0, [pending[1], pending[2]])
                if first[0]:
                    put(row, 0, "first", None, 0, list(first))
            index = pa.array(at, type=pa.int64())
            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(line, type=pa.int32()), pa.array(kind, type=pa.string()), pa.array(key, type=pa.string()), pa.array(flags, type=pa.int32()), pa.array(words, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "page", "line_no", "kind", "key", "flags", "words"])
            counts = [(lang, n, [*pair]) for lang, c in near.items() for pair, n in c.items()]
            if counts:
                # the task and batch in place of a page keep equal counts of two batches apart
                langs, sums, pairs = zip(*counts, strict=True)
                k, whose = len(counts), f"{TaskContext.get().taskAttemptId()}:{number}"
                columns = [pa.array([whose] * k), pa.array([-1] * k, pa.int32()), pa.array([-1] * k, pa.int32()), pa.array(["near"] * k), pa.array(langs), pa.array(sums, pa.int32()), pa.array(pairs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "page", "line_no", "kind", "key", "flags", "words"])

    rows = pages.where(F.col("doc").isNotNull() & F.col("page").isNotNull() & F.col("text").isNotNull()).select("doc", "page", "text")
    return rows.mapInArrow(run, "doc string, page int, line_no int, kind string, key string, flags int, words array<string>")


def decided(read: DataFrame, no_heads: DataFrame, counted: DataFrame, dictionaries: dict[str, Dictionary]) -> DataFrame:
    """``doc, page, line_no`` of lines that are misread by the true count of a rare form, or by what stands beside a doubtful one.

    ``no_heads`` are the lines (``doc, page, line_no``) that might have been running heads and are none.
    """
    shared = read.sparkSession.sparkContext.broadcast(dictionaries)
    cases = read.where("kind IN ('rare', 'doubt')")
    cases = cases.where("flags = 0").unionByName(cases.where("flags = 1").join(no_heads, ["doc", "page", "line_no"], "left_semi").select(cases.columns))
    rare = cases.where("kind = 'rare'").select("doc", "page", "line_no", F.col("key").alias("lang"), F.col("words")[0].alias("form"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong = [bool(shared.value[lang].explain(form, n)) for lang, form, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "form", "n")), strict=True)]
            yield batch.filter(pa.array(wrong, pa.bool_())).select(["doc", "page", "line_no"])

    # a form that no count was taken of (beside a stray mark, or cut) was seen once
    counts = rare.join(counted, ["lang", "form"], "left").select("doc", "page", "line_no", "lang", "form", F.coalesce("n", F.lit(1)).alias("n"))
    by_count = counts.mapInArrow(judge, "doc string, page int, line_no int")
    near = read.where("kind = 'near'").groupBy(F.col("key").alias("lang"), F.col("words")[0].alias("other"), F.col("words")[1].alias("beside")).agg(F.sum("flags").alias("n"))
    doubt = cases.where("kind = 'doubt'").select("doc", "page", "line_no", F.col("key").alias("lang"), F.col("words")[0].alias("form"), F.col("words")[1].alias("other"), F.explode(F.array(F.concat(F.lit("<"), F.col("words")[2]), F.concat(F.lit(">"), F.col("words")[3]))).alias("beside"))
    # the doubtful form's own neighbours: more than one page with the same ones speaks for the form
    own = doubt.select("lang", "form", "beside", "doc", "page").distinct().groupBy("lang", "form", "beside").agg(F.count(F.lit(1)).alias("mine"))
    asked = doubt.where(F.length("beside") > 1).join(near, ["lang", "other", "beside"]).join(own, ["lang", "form", "beside"])
    by_neighbours = asked.groupBy("doc", "page", "line_no", "form").agg(F.sum("n").alias("n"), F.sum("mine").alias("mine")).where(F.col("n") >= SUPPORT * F.col("mine")).select("doc", "page", "line_no")
    return by_count.unionByName(by_neighbours)


def page_noise(pages: DataFrame, corpus: DataFrame, lexicon: DataFrame, learned: tuple[dict[str, Dictionary], DataFrame] | None = None) -> DataFrame:
    """``doc, page, line_no, kind`` with kinds running_head, page_number, hyphen and misread.

    ``line_no`` is the 0-based position after splitting at ``\\n``. Null and empty pages have no rows,
    repeated rows of a page count once, null keys take no part, works missing from ``corpus`` are
    read without their title and author, an empty lexicon leaves frequency alone to decide.
    """
    dictionaries, counted = learned or learn(pages, lexicon)
    read = cut(read_pages(pages, dictionaries).distinct())
    edges = read.where("kind = 'edge'").select("doc", "page", "line_no", "key", "flags", F.col("words").isNull().alias("plain"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [head_key(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, type=pa.string())], names=["doc", "key"])

    works = corpus.where("doc IS NOT NULL").select("doc", F.explode(F.array("title", "author")).alias("name")).where("name IS NOT NULL")
    names = works.mapInArrow(keys, "doc string, key string").where("key <> ''")
    sections = edges.where("flags = 4").select("doc", "key")
    again = edges.where("flags < 4").groupBy("doc", "key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= HEAD_PAGES).select("doc", "key")
    heads = names.unionByName(sections).unionByName(again).distinct().withColumn("head", F.lit(True))
    judged = cut(edges.where("flags < 4").join(heads, ["doc", "key"], "left"))
    running = judged.where("head").select("doc", "page", "line_no", F.lit("running_head").alias("kind"))
    # a head with a reading error that its skeleton does not cover is one letter away from a head of the same work:
    # both leave the same letters when one is taken out
    long = F.length("key") >= LEAST_NEAR
    shorter = F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.concat(F.substring(F.col("key"), F.lit(1), k - 1), F.substring(F.col("key"), k + 1, F.length("key"))))
    variants = F.explode(F.array_distinct(F.concat(F.array("key"), shorter))).alias("variant")
    strange = judged.where("head IS NULL").where(long & F.col("plain")).select("doc", "key").distinct()
    # only heads that can be one letter away; few bytes become many variants, so they are spread before they are made
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near_lengths = strange.select("doc", F.explode(F.array(*[F.length("key") + d for d in (-1, 0, 1)])).alias("_l")).distinct()
    alike = heads.where(long).withColumn("_l", F.length("key")).join(near_lengths, ["doc", "_l"], "left_semi").select("doc", "key").repartition(tasks, "doc", "key")
    close = strange.repartition(tasks, "doc", "key").select("doc", "key", variants).join(alike.select("doc", variants).distinct(), ["doc", "variant"], "left_semi")
    close = close.select("doc", "key").distinct().withColumn("close", F.lit(True))
    near = cut(judged.where("head IS NULL").join(close, ["doc", "key"], "left").select("doc", "page", "line_no", "flags", "close"))
    running = running.unionByName(near.where("close").select("doc", "page", "line_no", F.lit("running_head").alias("kind")))
    other = near.where("close IS NULL")
    misread = other.where("flags % 2 = 1").select("doc", "page", "line_no", F.lit("misread").alias("kind"))
    hyphen = other.where("flags >= 2").select("doc", "page", "line_no", F.lit("hyphen").alias("kind"))
    # words cut at a page's end go on with the first body word of the next page
    head_first = judged.where("head").groupBy("doc", "page").agg(F.min("line_no").alias("head_line"))
    first = read.where("kind = 'first'").select("doc", "page", "words").join(head_first, ["doc", "page"], "left")
    first = first.select("doc", (F.col("page") - 1).alias("page"), F.when(F.col("head_line").isNotNull() & (F.col("head_line") < 3), F.col("words")[1]).otherwise(F.col("words")[0]).alias("next"))
    first = first.groupBy("doc", "page").agg(F.min("next").alias("next"))
    open_cuts = read.where("kind = 'cut'").select("doc", "page", "line_no", F.col("key").alias("lang"), F.col("words")[0].alias("a"), F.col("words")[1].alias("mark"))
    open_cuts = open_cuts.join(first, ["doc", "page"], "left").select("doc", "page", "line_no", "lang", "a", "mark", "next")
    shared = pages.sparkSession.sparkContext.broadcast(dictionaries)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value
            columns = [batch.column(c).to_pylist() for c in ("lang", "a", "mark", "next")]
            kept = [k for k, (lang, a, mark, after) in enumerate(zip(*columns, strict=True)) if line_cut(known[lang], a, after or "", mark)]
            index = pa.array(kept, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(index) for c in ("doc", "page", "line_no")], names=["doc", "page", "line_no"])

    late = open_cuts.mapInArrow(decide, "doc string, page int, line_no int").withColumn("kind", F.lit("hyphen"))
    done = read.where(F.col("kind").isin("page_number", "misread", "hyphen")).select("doc", "page", "line_no", "kind")
    open_lines = decided(read, other.select("doc", "page", "line_no"), counted, dictionaries).withColumn("kind", F.lit("misread"))
    return done.unionByName(running).unionByName(misread).unionByName(hyphen).unionByName(late).unionByName(open_lines).distinct()


#: Pages of a work whose paragraphs are ordered in one task.
PAGE_BUCKET = 512


def reflow_page(lines: list[str], kinds: dict[int, set[str]], d: Dictionary) -> list[tuple[str, bool, bool]]:
    """The pieces of paragraphs of a page: ``(text, starts a paragraph, ends inside a word)``, repaired."""
    pieces: list[list] = []
    blank = False
    for k, line in enumerate(lines):
        own = kinds.get(k, set())
        if own & {"running_head", "page_number"}:
            blank = False
            continue
        if not line.strip():
            blank = bool(pieces)
            continue
        words = line.split()
        torn = "hyphen" in own
        if torn:
            words[-1] = words[-1][:-1]
        out: list[str] = []
        j = 0
        while j < len(words):
            w = words[j]
            if j + 1 < len(words) and d.verdict(w) + d.verdict(words[j + 1]) and d.joined(w, words[j + 1]):
                w, j = w + words[j + 1], j + 1
            out.append(w if torn and j == len(words) - 1 else d.repair(w, "misread" in own))
            j += 1
        new = not pieces and line[:2] == "  " or bool(pieces) and (blank or line[:2] == "  ")
        if pieces and not new:
            last = pieces[-1]
            if last[2]:
                head, _, tail = last[0].rpartition(" ")
                last[0] = (head + " " if head else "") + d.repair(tail + out[0])
                out = out[1:]
            elif last[0][-1:] in "-‐":
                last[0] += out[0]
                out = out[1:]
            last[0] = " ".join([last[0], *out])
            last[2] = torn
        else:
            pieces.append([" ".join(out), new, torn])
        blank = False
    return [tuple(p) for p in pieces]


def paragraphs(pages: DataFrame, corpus: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc, page, piece, text``: continuous paragraphs of each work in reading order, repaired.

    ``page`` and ``piece`` say where the paragraph begins. Running heads and page numbers are left out,
    cut words are joined, misread words put right, and paragraphs go on over page ends. Null and empty
    pages add nothing; of repeated rows of a page one is read.
    """
    learned = learn(pages, lexicon)
    noise = page_noise(pages, corpus, lexicon, learned).groupBy("doc", "page").agg(F.collect_list(F.struct("line_no", "kind")).alias("noise"))
    once = pages.where("doc IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").groupBy("doc", "page").agg(F.min("text").alias("text"))
    shared = pages.sparkSession.sparkContext.broadcast(learned[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, texts, new, torn = [], [], [], [], []
            for row, (t, noise) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                kinds: dict[int, set[str]] = {}
                for x in noise or ():
                    kinds.setdefault(x["line_no"], set()).add(x["kind"])
                d = shared.value[page_language(Counter(t.split()))]
                for k, (piece, starts, ends) in enumerate(reflow_page(t.split("\n"), kinds, d)):
                    at.append(row)
                    number.append(k)
                    texts.append(piece)
                    new.append(starts)
                    torn.append(ends)
            index = pa.array(at, type=pa.int64())
            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(number, type=pa.int32()), pa.array(texts, type=pa.string()), pa.array(new, type=pa.bool_()), pa.array(torn, type=pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "page", "piece", "text", "new", "torn"])

    read = once.join(noise, ["doc", "page"], "left").select("doc", "page", "text", "noise")
    pieces = cut(read.mapInArrow(run, "doc string, page int, piece int, text string, new boolean, torn boolean"))
    # the beginning of each piece's paragraph: the last start at or before it, found per bucket of pages, then over buckets
    start = F.when(F.col("new") | (F.col("piece") > 0), F.struct("page", "piece"))
    marked = pieces.withColumn("bucket", F.floor(F.col("page") / PAGE_BUCKET)).withColumn("start", start)
    inside = Window.partitionBy("doc", "bucket").orderBy("page", "piece").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("own", F.last("start", ignorenulls=True).over(inside))
    ends = marked.groupBy("doc", "bucket").agg(F.max("start").alias("end"), F.min(F.struct("page", "piece")).alias("first"))
    before = Window.partitionBy("doc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc", "bucket", F.coalesce(F.max("end").over(before), F.min("first").over(Window.partitionBy("doc"))).alias("carried"))
    joined = marked.join(carried, ["doc", "bucket"]).withColumn("begin", F.coalesce("own", "carried"))
    grouped = joined.groupBy("doc", "begin").agg(F.array_sort(F.collect_list(F.struct("page", "piece", "text", "torn"))).alias("parts"))
    glue = F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit(True).alias("torn")), lambda acc, x: F.struct(F.concat(acc["text"], F.when(acc["torn"], F.lit("")).otherwise(F.lit(" ")), x["text"]).alias("text"), x["torn"].alias("torn")))
    return grouped.select("doc", F.col("begin.page").alias("page"), F.col("begin.piece").alias("piece"), glue["text"].alias("text"))
