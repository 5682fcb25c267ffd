"""Broken prompt and response pairs (problem 1).

Empty, copied, refusing and foreign-language answers are told by rules on the pair. Truncation needs
the corpus: the last, unfinished piece of an answer is sorted among all sentences of all answers, and
the longest prefix it shares with its nearest finished neighbours shows whether it is a sentence cut
short or a short answer of its own. Answers that pile up at one length of their model, unfinished,
show a length limit. Sorting is by range over all workers; equal texts are merged first, and only the
edges of each range travel to the next one, so no group of answers is held in one task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.sizes import broadcast_if_small
from inkstone.llm.sentences import SCRIPTS, WORD_LANGUAGE, language
from inkstone.session import cut

#: Words that an unfinished piece shares with a finished sentence's beginning if it is one cut short.
SHARED_WORDS = 3
#: One shared word less is enough for a piece of so many words.
LONG_PIECE = 9
#: Words that are enough behind finished sentences of the same answer.
SHARED_AFTER = 1
#: A length of a model is a limit if this many unfinished answers have it and they are this many times those of the neighbouring lengths.
SPIKE_ANSWERS, SPIKE_RATIO, SPIKE_LENGTH = 20, 8.0, 120

CITATION = re.compile(r"\[[^\[\]\n]{0,80}?,\s*(?:pp?|S|стр)\.\s*[\d–-]+\s*\]|\[P?\d+\]|\((?:cf\.|see)?\s*[^()\n]{0,60},\s*pp?\.\s*\d+\)")
HIDDEN = re.compile("[​­‌‍⁠﻿ ]")
FENCE = re.compile(r"^\s*```\w*\s*|\s*```\s*$")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
LABEL = re.compile(r"^\s*(?:\*\*)?(?:A|Q|Answer|Question|Response|Antwort|Frage|Réponse|Question|F|R|答|问|答案|回答|问题)(?:\*\*)?\s*[:：]\s*", re.I)
# fixed values: what stands for an answer that was not given
PLACEHOLDERS = set("none|null|nil|nan|n a|na|no answer|answer|empty|tbd|todo|unknown|undefined|blank|answer here|not available|not applicable|no response|response|keine|keine antwort|leer|ohne antwort|k a|aucune|aucune réponse|vide|sans réponse|néant|无|空|暂无|没有答案|无答案|なし|無し|回答なし|ไม่มี|कोई नहीं|उत्तर नहीं|your answer|insert answer here|xxx".split("|"))
#: Word classes that English refusals are made of: verbs of answering, of being able or willing, what an answer would rest on.
_ACTS = r"(?:answer|say|tell|judge|decide|discuss|comment|compare|provide|give|help|determine|assess|speak|respond|address|assist|offer|take (?:a|any) (?:side|position|view)|form (?:a|any) (?:view|opinion))"
_BASIS = r"(?:passages?|excerpts?|texts?|material|context|sources?|quotations?|pages?|documents?|information)"
_LIMIT = r"(?:cannot|can not|can't|can’t|could not|couldn't|couldn’t|won't|won’t|will not|would not|wouldn't|am unable|am not able|am not (?:allowed|permitted|qualified|competent|in a position)|unable|not able|would rather not|would prefer not|prefer not|must (?:decline|refuse|pass)|have to (?:decline|refuse|pass)|decline|refuse|don't have|do not have|don’t have|lack|do not feel|don't feel|don’t feel)"
#: Refusals, one pattern a language, by structure: the speaker or the material as subject, a limit of ability, right or will, an act of
#: answering; each is tried on single sentences without their quotations.
REFUSALS = {
    "en": rf"\bI(?:'m|’m)?(?: \w+)?(?: am)? {_LIMIT}\b"
    rf"|\b(?:unable|not able|impossible|not possible|isn't possible|isn’t possible|no way)\b(?: for me)? to {_ACTS}\b|\bno way for me\b"
    rf"|\b{_BASIS}\b[^.!?]{{0,40}}\b(?:do(?:es)? not|don't|doesn't|don’t|doesn’t|fails? to) (?:contain|provide|give|offer|say|allow|permit|let|tell|cover|mention)\b"
    r"|\b(?:nothing|none|not a word|no (?:passage|part|line|word|page))\b[^.!?]{0,40}\b(?:lets?|allows?|permits?|enables?|helps?|tells?)\b[^.!?]{0,10}\b(?:me|us|one)\b"
    r"|\b(?:leaves?|gives?|offers?|provides?)\b (?:me|us)\b[^.!?]{0,20}\b(?:without|unable|no|nothing|too little)\b"
    r"|\b(?:beyond|outside|above|not within)\b (?:what I|my)\b|\bnot\b[^.!?]{0,25}\bI\b[^.!?]{0,15}\b(?:able|allowed|permitted|competent|qualified|ready|willing|free|comfortable)\b"
    r"|\b(?:put|address|refer|take|bring|direct|leave)\b[^.!?]{0,25}\bto (?:somebody|someone|anybody|anyone|others)\b|\b(?:ask|consult|turn to)\b[^.!?]{0,6}\b(?:somebody|someone|another|an expert|a specialist|a scholar)\b"
    r"|\bnot (?:allowed|permitted|in a position) to\b",
    "de": r"\bkann ich\b.{0,60}\bnicht\b|\bich kann\b.{0,60}\bnicht\b|\b(?:darf|möchte|will|werde) ich\b.{0,60}\b(?:keine?|nicht|kein)\b|\bich (?:darf|möchte|will|werde|muss)\b.{0,60}\b(?:keine?|nicht|ablehnen|passen)\b|\breicht (?:das|der|die)\b.{0,50}\bnicht\b|\b(?:das|der|die) (?:Material|Text|Passagen?|Auszüge?|Stellen?)\b.{0,50}\b(?:nicht aus|reich(?:t|en) nicht|keine)\b|\bnicht möglich\b.{0,40}\b(?:zu|Antwort)\b|\bist es mir nicht\b|\bbin ich nicht\b|\bmuss ich ablehnen\b|\blässt sich (?:aus|anhand|dazu|darüber)\b.{0,60}\b(?:nicht|nichts)\b|\bkeinen Zugriff\b|\bsehe ich mich\b|\bgeht über das hinaus\b",
    "fr": r"\bje (?:ne|n')\s*(?:\w+\s+)?(?:peux|puis|suis|dispose|ai|saurais|veux|souhaite|préfère)\b|\bje n'ai\b|\bje (?:préfère|préférerais) (?:ne pas|m'abstenir)\b|\bje dois (?:décliner|refuser|m'abstenir)\b|\bil (?:ne )?m'est (?:impossible|pas possible)\b|\bm'est impossible\b|\b(?:passages?|extraits?|texte|documents?)\b.{0,50}\b(?:ne|n')\s*\w+ pas\b.{0,60}|\brien (?:dans|ne)\b.{0,40}\bpermet\b|\bpas (?:assez|suffisamment) d'informations?\b|\bimpossible de (?:répondre|trancher|dire|comparer)\b|\bau-delà de ce que je\b",
    "zh": r"(?:我|本助手)?(?:无法|不能|没法|没有办法|不便|不方便|无权|不可以|难以)(?:对此|对这个|就此|回答|判断|比较|发表|提供|作答|评论|给出|协助|帮)|没有足够的(?:信息|材料|依据)|信息不足|不足以(?:回答|判断)|未提供|恕(?:我)?(?:难|不)|拒绝回答|我(?:必须|只能|不得不)(?:拒绝|谢绝)",
    "ja": r"お答えできません|回答できません|答えられません|申し訳|判断できません|お断り|情報が(?:足りません|不足)|控え(?:させて|ます)|わかりかねます",
    "th": r"ไม่สามารถ(?:ตอบ|ให้|เปรียบเทียบ|ตัดสิน)|ขออภัย|ขอโทษ|ไม่มีข้อมูล(?:เพียงพอ)?|ข้อมูลไม่เพียงพอ",
    "hi": r"उत्तर नहीं दे सकता|जवाब नहीं दे|असमर्थ हूँ|क्षमा (?:करें|कीजिए)|पर्याप्त जानकारी नहीं|माफ़ कीजिए",
}
REFUSAL = {k: re.compile(v, re.I | re.S) for k, v in REFUSALS.items()}
#: A refusal that somebody else utters, or a word that is only talked about.
REPORTED = re.compile(r"\b(?:says|said|writes?|wrote|replied|replies|asked|answers|answered|exclaims?|confess(?:es|ed)|reads|(?:begins?|ends?|closes) with|sagt|sagte|schreibt|schrieb|antwortet|antwortete|dit|écrit|écrivit|répondit|répond)\b|他(?:说|写道)|她(?:说|写道)|写道")
QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"\n]*\"")
PIECE = re.compile(r"(?<=[^\W\d_]{3}[.!?])[\"'“”’»)\]]*\s+(?![a-z\d])|(?<=\d{3}[.!?])\s+(?=[A-Z])|(?<=[!?])[\"'“”’»)\]]*\s+(?![a-z])|(?<=[。！？।])[”」』]*|\n+")
#: Two things named side by side, which a short answer may consist of.
BESIDE = re.compile(r"\s+(?:and|und|et)\s+|[和与，]")
LIST_LINE = re.compile(r"^\s*(?:[-–—•*·]|\(?\d{1,2}[.)]|\(?[a-z]\))\s+(?=\S)")
TERMINAL = re.compile(r"[.!?。！？।॥|…](?:\s?[\"'“”’»」』)\]）])*$")
NUMBER_WORDS = {w: n for n, names in enumerate(("", "one ein eine un une 一", "two zwei deux 两 二", "three drei trois 三", "four vier quatre 四", "five fünf cinq 五", "six sechs 六", "seven sieben sept 七")) for w in names.split()}
ANNOUNCED = re.compile(r"\b(" + "|".join(w for w in NUMBER_WORDS if w.isascii() or w == "fünf") + r")\b[^.!?:\n]{0,40}[:：]\s*$|([一二两三四五六七])[^。！？：\n]{0,12}[：:]\s*$", re.I)
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def plain(text: str | None) -> str:
    """Without invisible characters and fences."""
    return HIDDEN.sub(lambda m: " " if m.group(0) == " " else "", text or "").strip()


def letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def body(answer: str) -> str:
    """An answer without wrappers, labels and citations of its sources."""
    text = plain(answer)
    while True:
        shorter = LABEL.sub("", FENCE.sub("", text)).strip()
        if shorter == text:
            break
        text = shorter
    return CITATION.sub("", text).strip()


#: What stands between the parts of a citation.
CITING = set("p pp s see cf vgl voir ibid ebd and und et in of the page pages seite seiten".split())


def only_cites(text: str, sources: str) -> bool:
    """Whether a text is made of nothing but names, titles and sections of its sources, with at least one page number."""
    words = re.findall(r"[^\W_]+", text.lower())
    if not any(w.isdigit() for w in words):
        return False
    known = set(re.findall(r"[^\W_]+", sources.lower())) | CITING
    return all(w in known or w.isdigit() for w in words) and not text.rstrip().endswith((".", "!", "?"))


def is_empty(answer: str | None, sources: str = "") -> bool:
    """States nothing: blank, wrappers, placeholders, or only citations, such as ``sources`` (the words of the pair's sources) would give."""
    text = body(answer or "")
    text = TAG.sub("", text)
    text = re.sub(r'^[\s{\["\']*(?:answer|response|text)["\']?\s*[:=]', "", text, flags=re.I)
    words = " ".join(WORD.findall(text.lower()))
    return not words or words in PLACEHOLDERS or bool(sources) and only_cites(text, sources)


def without_question(question: str, text: str) -> tuple[str, bool]:
    """The answer without leading repetitions of the question, and whether there were any."""
    target = letters(LABEL.sub("", plain(question)))
    repeated = False
    while len(target) > 8:
        rest = re.sub(r"^[\s>\"'“„«「*_#]+", "", text)
        rest = LABEL.sub("", rest)
        at = n = 0
        while at < len(rest) and n < len(target):
            if rest[at].isalnum():
                if rest[at].lower() != target[n : n + 1]:
                    break
                n += 1
            at += 1
        if n < len(target):
            break
        repeated = True
        text = re.sub(r"^[\s?？!.。”\"'»」*_:：-]*", "", rest[at:])
    return text, repeated


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing beyond the question: repeated, quoted, announced, or asked back in the same words."""
    if not question or len(letters(question)) < 8:
        return False
    text = body(answer)
    rest, repeated = without_question(question, text)
    if repeated and not letters(rest):
        return True
    own, asked = letters(text), letters(LABEL.sub("", plain(question)))
    if len(asked) > 12 and asked in own and not repeated:
        before, _, after = own.partition(asked)
        head = text[: max(0, len(text) // 2)]
        return len(after) == 0 and len(before) <= max(40, len(asked) // 2) and not re.search(r"[.!?。！？]\s", head[: len(before) + 6])
    if repeated:
        return False
    mine, theirs = Counter(w.lower() for w in WORD.findall(text)), Counter(w.lower() for w in WORD.findall(question))
    if sum(theirs.values()) >= 5:
        shared = sum((mine & theirs).values())
        return shared >= 0.9 * sum(theirs.values()) and sum(mine.values()) - shared <= max(2, 0.3 * sum(theirs.values())) and "?" in text
    return False


def pieces(text: str) -> list[str]:
    return [p.strip() for p in PIECE.split(text) if p and p.strip()]


def refuses(sentence: str) -> bool:
    open_text = QUOTED.sub(" ", sentence)
    if REPORTED.search(open_text):
        return False
    return any(p.search(open_text) for p in REFUSAL.values())


def is_refusal(question: str | None, answer: str) -> bool:
    """Has a whole sentence that declines, apart from a repeated question; what others decline does not count."""
    text, _ = without_question(question or "", body(answer))
    return any(TERMINAL.search(part) and refuses(part) for part in pieces(text))


def votes(text: str) -> Counter:
    """Evidence for languages: characters of scripts, function words of the Latin script."""
    counts: Counter = Counter()
    for name, pattern in SCRIPTS:
        counts[name] += len(pattern.findall(text)) / 3
    if counts["ja"] > 0.1 * counts["zh"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in WORD_LANGUAGE:
            counts[WORD_LANGUAGE[w]] += 1
    for mark, lang in (("é", "fr"), ("è", "fr"), ("ç", "fr"), ("ß", "de"), ("ü", "de"), ("ö", "de"), ("ä", "de")):
        counts[lang] += 0.5 * min(2, text.lower().count(mark))
    return counts


def is_other_language(question: str | None, answer: str) -> bool:
    """Mainly in a language other than the question's; quotations do not count."""
    if not question:
        return False
    asked = language(question)
    text, _ = without_question(question, body(answer))
    counts = votes(QUOTED.sub(" ", text))
    if asked == "xx" or not counts:
        return False
    best = max(sorted(counts), key=counts.__getitem__)
    return best != asked and counts[best] >= 2 and counts[best] > 2 * counts[asked]


@dataclass
class Ending:
    """How an answer ends: ``cut`` is sure truncation, ``tail`` an unfinished last piece to compare."""

    cut: bool = False
    tail: str = ""
    alone: bool = False
    finished: list[str] = field(default_factory=list)
    entries: list[str] = field(default_factory=list)


def unclosed(text: str) -> bool:
    if any(text.count(o) > text.count(c) for o, c in (("(", ")"), ("（", "）"), ("«", "»"), ("「", "」"))):
        return True
    if "„" in text:
        return text.count("„") > text.count("“") + text.count("”")
    return text.count("“") > text.count("”")


# fixed values: words and marks that cannot end an answer
DANGLING = re.compile(r"(?:[,;:，；：、–—(\[„«「-]|\b(?:and|or|but|because|which|that|the|a|an|of|to|for|with|as|if|than|by|from|in|on|is|are|was|not|und|oder|aber|weil|dass|der|die|das|den|dem|ein|eine|von|zu|mit|als|wenn|et|ou|mais|parce|que|qui|le|la|les|un|une|des|du|de|dont|si)|\b(?:e\.g|i\.e|cf|viz|vol|vs|pp?|Mr|Mrs|Dr|St|No|Fig|ch|approx|ca|vgl|Bd|d\. h|z\. B|p\. ex|c\.-à-d|M)\.|而|因为|和|与|的|但)$", re.I)


def ending(question: str | None, answer: str) -> Ending:
    """Takes an answer apart; lists are complete if they have as many entries as announced."""
    raw = plain(answer)
    text, _ = without_question(question or "", body(answer))
    text = CITATION.sub("", text).rstrip()
    # an opened citation or bracket at the very end is a cut
    if re.search(r"\[[^\]]*$", raw):
        return Ending(cut=True)
    if not text:
        return Ending()
    lines = [x for x in re.split(r"[\n\r]+", text) if x.strip()]
    entries = [k for k, x in enumerate(lines) if LIST_LINE.match(x)]
    finished = [p for p in pieces("\n".join(x for k, x in enumerate(lines) if k not in entries)) if TERMINAL.search(p)]
    if re.fullmatch(r"\s*(?:[-–—•*]|\(?\d{1,2}[.)])\s*", lines[-1]) and len(lines) > 1:
        return Ending(cut=True, finished=finished)
    if entries and entries[-1] == len(lines) - 1:
        first = entries[0]
        while first - 1 in entries:
            first -= 1
        lead = lines[first - 1] if first else ""
        m = ANNOUNCED.search(lead.strip())
        named = [LIST_LINE.sub("", lines[k]).strip(" .;,").lower() for k in entries[:-1]]
        if m:
            wanted = NUMBER_WORDS.get((m.group(1) or m.group(2)).lower(), 0)
            return Ending(cut=wanted > len(entries), finished=finished, entries=named)
        last = LIST_LINE.sub("", lines[-1]).strip()
        return Ending(cut=bool(DANGLING.search(last)), finished=finished, entries=named)
    if ANNOUNCED.search(lines[-1].strip()):
        return Ending(cut=True, finished=finished)
    if DANGLING.search(text):
        return Ending(cut=True, finished=finished)
    if TERMINAL.search(text):
        return Ending(cut=unclosed(text), finished=finished)
    last = pieces(text)[-1]
    if unclosed(text):
        return Ending(cut=True, finished=finished)
    return Ending(tail=last, alone=len(pieces(text)) == 1, finished=finished)


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def cut_short(tail: str, neighbours: list[str], least: int = SHARED_WORDS) -> bool:
    """Whether an unfinished piece begins like a finished sentence that goes on beyond it, in ``least`` words or as many characters and one more of scripts without spaces."""
    n = max((shared_prefix(tail, x) for x in neighbours), default=0)
    if n == len(tail):
        return True
    shared = tail[:n]
    if any(p.search(tail) for _, p in SCRIPTS):
        return len(shared.strip()) > least
    whole = shared if n < len(tail) and not tail[n : n + 1].isalnum() else re.sub(r"\w+$", "", shared)
    shared_words, all_words = len(WORD.findall(whole)), len(WORD.findall(tail))
    return shared_words >= least or all_words >= LONG_PIECE and shared_words >= least - 1


def sorted_neighbours(items: DataFrame, text: str, anchor: str) -> DataFrame:
    """For each text that is not an anchor its nearest anchors before and after in the order of all texts.

    ``items`` has distinct ``text`` and a boolean ``anchor``. Each range of the order passes only its
    first and last anchor on.
    """
    spark = items.sparkSession
    width = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(items.select(text, anchor).repartitionByRange(width, text).sortWithinPartitions(text))
    part = F.spark_partition_id()
    edges = ordered.where(anchor).withColumn("_p", part).groupBy("_p").agg(F.min(text).alias("first"), F.max(text).alias("last")).collect()  # one row a range
    edges.sort(key=lambda r: r["_p"])
    numbers, firsts, lasts = [r["_p"] for r in edges], [r["first"] for r in edges], [r["last"] for r in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        k = bisect_right(numbers, here)
        before = lasts[k - 1 - (k > 0 and numbers[k - 1] == here)] if k - (k > 0 and numbers[k - 1] == here) > 0 else None
        after = firsts[k] if k < len(firsts) else None
        waiting: list[tuple[str, str | None]] = []
        out: list[tuple[str, str | None, str | None]] = []
        for batch in batches:
            for t, is_anchor in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if is_anchor:
                    out += [(w, b, t) for w, b in waiting]
                    waiting.clear()
                    before = t
                else:
                    waiting.append((t, before))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], names=[text, "before", "after"])
                out = []
        out = [(w, b, after) for w, b in waiting]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], names=[text, "before", "after"])

    return ordered.mapInArrow(run, f"{text} string, before string, after string")


def source_words(df: DataFrame, sources: str) -> Column:
    """Authors, titles and sections of a pair's sources as one text; '' where the table has none or they are null."""
    kind = dict(df.dtypes).get(sources, "")
    if not kind.startswith("array<struct"):
        return F.lit("")
    fields = [f for f in ("author", "title", "section") if re.search(rf"[<,]{f}:string", kind)]
    if not fields:
        return F.lit("")
    return F.coalesce(F.array_join(F.transform(sources, lambda x: F.concat_ws(" ", *[x[f] for f in fields])), " "), F.lit(""))


def defective_pairs(df: DataFrame, key: str = "id", question: str = "question", answer: str = "answer", model: str = "model", sources: str = "sources") -> DataFrame:
    """``key, defect`` for each defective pair: empty, copy, refusal, other_language or truncated.

    A pair has one defect, the first that applies in this order. Null and blank answers are empty; a
    null question can only have an empty, refusing or truncated answer. Repeated rows of a key count
    once, null keys take no part, further columns are not read. Texts are taken whole.
    """
    kind = dict(df.dtypes)[key]
    fields = F.struct(F.col(question).alias("question"), F.col(answer).alias("answer"), F.coalesce(model, F.lit("")).alias("model"), source_words(df, sources).alias("sources"))
    once = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by(fields, F.struct(F.coalesce(F.length(answer), F.lit(-1)), answer, question)).alias("r")).select("key", "r.*")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, a, cited in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), batch.column("sources").to_pylist(), strict=True):
                defect, end = None, Ending()
                if is_empty(a, cited):
                    defect = "empty"
                else:
                    end = ending(q, a)
                    if is_copy(q, a):
                        defect = "copy"
                    elif is_refusal(q, a):
                        defect = "refusal"
                    elif is_other_language(q, a):
                        defect = "other_language"
                    elif end.cut:
                        defect = "truncated"
                rows.append((defect, end.tail if defect is None else "", end.alone, end.finished if defect in (None, "truncated") else [], end.entries, [x.strip().lower() for x in BESIDE.split(end.tail)] if end.alone else [], len(a or "")))
            names = ["defect", "tail", "alone", "finished", "entries", "parts", "length"]
            types = [pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.string())] * 3, pa.int32()]
            columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], type=t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("model"), *columns], names=["key", "model", *names])

    judged = cut(once.mapInArrow(judge, f"key {kind}, model string, defect string, tail string, alone boolean, finished array<string>, entries array<string>, parts array<string>, length int"))
    tails = judged.where("tail <> ''")
    items = judged.select(F.explode("finished").alias("text")).select("text", F.lit(True).alias("anchor")).unionByName(tails.select(F.col("tail").alias("text"), F.lit(False).alias("anchor")))
    items = items.groupBy("text").agg(F.max("anchor").alias("anchor"))
    near = sorted_neighbours(items, "text", "anchor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, after = (c.to_pylist() for c in batch.columns)
            near = [(t, [x for x in (b, a) if x]) for t, b, a in zip(texts, before, after, strict=True)]
            columns = [pa.array([cut_short(t, x, least) for t, x in near], type=pa.bool_()) for least in (SHARED_WORDS, SHARED_AFTER)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["tail", "short", "begun"])

    short = near.mapInArrow(compare, "tail string, short boolean, begun boolean")
    # lengths at which unfinished answers of a model pile up
    lengths = tails.groupBy("model", "length").agg(F.count_distinct("tail").alias("n"))
    around = lengths.select("model", F.explode(F.array([F.col("length") + d for d in (-2, -1, 1, 2)])).alias("length"), (F.col("n") / 4).alias("m")).groupBy("model", "length").agg(F.sum("m").alias("m"))
    spikes = lengths.join(around, ["model", "length"], "left").where((F.col("length") >= SPIKE_LENGTH) & (F.col("n") >= SPIKE_ANSWERS) & (F.col("n") >= SPIKE_RATIO * F.coalesce("m", F.lit(0.1)))).select("model", "length", F.lit(True).alias("spike"))
    # short answers that name things side by side which complete lists name, too
    named = judged.select(F.explode("entries").alias("part")).distinct().withColumn("known", F.lit(True))
    asked = tails.where(F.size("parts") > 1).select("tail", F.explode(F.array_distinct("parts")).alias("part")).distinct()
    beside = asked.join(named, "part", "left").groupBy("tail").agg(F.count("known").alias("k"), F.count(F.lit(1)).alias("n")).where("k = n").select("tail", F.lit(True).alias("beside"))
    joined = tails.join(short, "tail", "left").join(beside, "tail", "left").join(broadcast_if_small(spikes), ["model", "length"], "left")
    # behind finished sentences an unfinished piece that begins as any sentence does is cut; one that stands alone may be a short answer
    late = joined.where((~F.col("alone") & F.coalesce("begun", F.lit(False))) | (F.coalesce("short", F.lit(False)) & F.col("beside").isNull()) | F.coalesce("spike", F.lit(False))).select("key", F.lit("truncated").alias("defect"))
    return judged.where("defect IS NOT NULL").select("key", "defect").unionByName(late).withColumnRenamed("key", key)
