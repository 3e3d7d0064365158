"""Template residue and error pages in place of content.

Lines are reduced to message templates by a prefix tree of fixed depth: one level for the number of words, then one for
each of the first words and the last one, numbers, hexadecimal strings and paths masked; lines of a leaf that agree in
most words share a template, with wildcards where they differ; telling words, that is those the classes rest on, are
never made wildcards, so lines that differ in one stay apart. The tree is that of the whole corpus, leaf by leaf over
its distinct lines in their order, whatever the batches and partitions. Each template is classified once, over its whole
length, by the first of its lines, and the verdict goes back to all lines of it. Lines without any telling word, which no
other lines share a template with that isn't content, are only counted.
Unfilled slots are looked for in all lines apart from that. A text is residue if it has a slot, or if
it has lines of residue and next to nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.boilerplate import menu_items
from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

DEPTH, SIMILAR = 4, 0.6
#: A text of residue has at most so many words besides, its first line aside, as that may be a heading or claim that was kept.
REST_WORDS, FIRST_WORDS = 14, 60
#: Of a line with more words than these a message further on counts only if the rest of the line is no real text.
HEAD_WORDS = 48
#: Filler words that make a line filler if at most ``REST_WORDS`` others stand beside; words beside a phrase of fillers.
FILLER_WORDS, FILLER_REST = 12, 6
WILDCARD = "<*>"
#: A message wrapped over lines reaches at most so many words past its first line; running text has so many words in lower case on end.
WINDOW_WORDS, RUN_WORDS = 16, 5

# Names of HTML elements that are mark-up and not placeholders.
_TAGS = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|div|span|br|hr|a|b|i|em|strong|ul|ol|li|pre|code|table|t[rdh]|section|article|header|footer|nav|main|img|meta|link|script|style)\b[^<>]*>", re.I)
# Marker strings of tokenizers, which are no placeholders.
_MARKERS = frozenset("PAD UNK BOS EOS CLS SEP MASK S EOT EOD SOS NUL".split())
_SLOTS = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^{}\n]+%\}|<%[^<>\n]+%>|[$#]\{[A-Za-z_][\w. -]*\}|%\([A-Za-z_]\w*\)[sdrfi]"
    r"|(?<![\w$#{%\\])\{[A-Za-z_][a-z0-9_]+\}(?![}\w])|__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__|@@[A-Za-z]\w*@@|%%[A-Za-z]\w*%%|(?<!\w)%[A-Z][A-Z0-9_]{2,}%(?!\w)"
    r"|<([A-Z][A-Z0-9]+(?:[ _-][A-Z0-9]+)*)>|\[\[[A-Za-z_][\w -]*\]\]"
    r"|\[\s*(?:insert|enter|add|your|put|replace|fill in|tbd|tbc|todo)\b[^\]\[\n]*\]|\[[^\]\[\n]+\s(?:goes\s)?here\s*\]",
    re.I,
)
_UPPER_SLOT = re.compile(r"<([A-Z][A-Z0-9]+(?:[ _-][A-Z0-9]+)*)>")
_OPENERS, _CLOSERS = "“„«\"'‘", "”“»\"'’"
_PARTING = frozenset("“”„«»\"'‘’|·•:=[]{}()")
# Words of the usual filler text.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# Phrases of fillers, by language.
_FILLER = re.compile(r"\b(?:sample text|your text here|text goes here|dummy (?:paragraph|text|content)|placeholder text|blah blah|asdf|qwer(?:ty)?\b.*\basdf|foo bar baz|texte? à remplacer|faux texte|blindtext|platzhaltertext|texto de (?:ejemplo|relleno|prueba)|текст-рыба|текст для примера|lorem ipsum)\b", re.I)
# Messages in place of content, by kind and language: those that start a line, as their words are also used in prose;
_STARTS = re.compile(
    r"""\W{0,3}(?:
    (?:http\W{0,3})?(?:error\W{1,3})?[45]\d\d(?:\W|$)
    |(?:http\s+status|http|status(?:\s+code)?|error)\W{1,3}(?:[45]\d\d|code|<\*>)(?:\W|$)
    |access\s(?:to\sthis\s\w+\s(?:is|was|has\sbeen)\s)?denied\b|(?:you\s(?:have\sbeen|are|were)|your\s(?:address|ip|request|account)\b.{0,30})\s(?:blocked|banned)
    |(?:this\s)?(?:page|article|content|link|item|video|post|story)\s(?:is|has|was)\s(?:no\slonger\s(?:available|exists?)|expired|been\s(?:removed|deleted))
    |the\srequested\s\w+\s(?:could\snot|was\snot|cannot)|nothing\shere\b|(?:an?|un)\s(?:unexpected\s)?error\s(?:has\s)?occurred
    |(?:die\s)?seite\s(?:wurde\s)?nicht\sgefunden|zugriff\sverweigert|(?:sitzung|ihre\ssitzung)\b.{0,20}abgelaufen|page\s(?:introuvable|non\strouvée)|accès\s(?:refusé|interdit)|(?:votre\s)?session\sa\sexpiré
    |página\sno\s(?:encontrada|existe)|acceso\sdenegado|(?:su\s)?sesión\sha\s(?:caducado|expirado)|страница\sне\sнайдена|доступ\sзапрещ[её]н|ошибка\s(?:\d{3}|<\*>)
    )""",
    re.I | re.X,
)
# those that end one;
_ENDS = re.compile(r"(?:internal\sserver\serror|bad\sgateway|gateway\stime-?out|service\s(?:temporarily\s)?unavailable|too\smany\srequests|page\snot\sfound|not\sfound|forbidden|unauthorized|bad\srequest|gone)\W{0,3}\(?(?:\d{0,3}|<\*>)\)?\W*$", re.I)
# and those that hold wherever they stand.
_ANYWHERE = re.compile(
    r"""\b(?:verify\s(?:that\s)?you\sare\s(?:a\s)?human|unusual\straffic|checking\syour\sbrowser|complete\sthe\scaptcha|are\syou\sa\srobot
    |(?:session|link|token|login)\s(?:has|is)\s(?:timed\sout|expired)|(?:can(?:no|['’])?t|could\snot|unable\sto)\s(?:find|load|display)\s(?:that|this|the)\s(?:requested\s)?page|address\syou\sfollowed
    |something\swent\swrong|please\s(?:try\sagain|reload)|(?:enable|turn\son|activate|allow|switch\son)\s(?:java\s?script|scripts?|cookies)\b|java\s?script\s(?:is|must\sbe|has\sto\sbe)\s(?:disabled|enabled|required|off|turned)
    |(?:requires?|needs?)\sjava\s?script|aktivieren\ssie\s(?:bitte\s)?java\s?script|java\s?script\s(?:ist\sdeaktiviert|aktivieren)|active[rz]?\s(?:le\s)?java\s?script|java\s?script\s(?:est\sdésactivé|está\sdesactivado)
    |(?:habilite|activar|habilitar)\sjava\s?script|включите\sjava\s?script|java\s?script\sотключ)""",
    re.I | re.X,
)
# Output of programs and servers.
_OUTPUT = re.compile(
    r"""^\W{0,3}traceback\s\(most\srecent|^\s*file\s".+",\sline\s|^\s*at\s[\w.$<>]+\(.*\)\s*$|[A-Za-z](?:Exception|Error):\s|(?:exception|error):\s.{0,200}\bis\snull|^\W{0,3}(?:fatal|parse|syntax|notice|warning|deprecated)\W{1,3}(?:error\W{1,3})?.{0,200}\b(?:undefined|line|unexpected|deprecated|failed)\b
    |\bSQLSTATE\b|\bORA-\d{4,}|\bsegmentation\sfault\b|\bcore\sdumped\b|\bpanic:\s|\bstack\s?trace\b|\bconnection\s(?:refused|timed\sout|reset)\b|\bnull\s?pointer|\bkeyerror\b|^\W*\{\s*"(?:error|message|code|status)"\s*:|^\s*\w+\s=\s\w+\[.*\]\s*$|^\s*\^+\s*$""",
    re.I | re.X,
)
_VALUES = re.compile(r"^\W*(?:[\w ]{1,20}:\s*)?(?:nan|none|null|nil|undefined|\[object object\]|n/a|#(?:ref|value|name|n/a)[!?]?)\W*$", re.I)
_TODO = re.compile(r"^\W*(?:TODO|FIXME|TBD|XXX)\b\s*[:\-–]?")
_WRAPPER = re.compile(r"^\W*(?:©.*|(?:request|ray|trace|incident|reference)\s?(?:id|no|number)?\W{0,3}\w*[\da-f]{4,}\w*|(?:nginx|apache|openresty|cloudflare|iis)\b.*|try again(?: later)?|headline|untitled|\d+)\W*$", re.I)
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?]+")
_ENDED = re.compile(r"[.!?…][”“»\"'’)\]]*$")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
# Parts of words one of which each phrase of fillers, and each message that ends a line, has.
_FILLER_KEYS = ("text", "dummy", "placeholder", "blah", "asdf", "foo bar", "ipsum", "текст")
_END_KEYS = ("error", "gateway", "unavailable", "requests", "found", "forbidden", "unauthorized", "bad request", "gone")
_START_KEYS = ("error", "http", "status", "denied", "blocked", "banned", "no longer", "expir", "removed", "deleted", "the requested", "nothing here", "gefunden", "verweigert", "abgelaufen", "introuvable", "trouvée", "refus", "interdit", "encontrada", "existe", "denegado", "caducado", "найдена", "запрещ", "ошибка")
# Parts of words one of which each message that holds anywhere, or output, has; patterns are tried only on lines with one.
_MESSAGE_KEYS = ("human", "traffic", "browser", "captcha", "robot", "timed out", "expired", "page", "followed", "went wrong", "please", "script", "cookies")
_OUTPUT_KEYS = ("traceback", "exception", "error", "fatal", "parse", "notice", "warning", "deprecated", "sqlstate", "ora-", "segmentation", "core dumped", "panic:", "stack", "connection", "pointer", "message", "code", "status", " = ", "^")


#: The words that stand in the patterns; a template keeps them.
_TELLING = frozenset(w.lower() for p in (_STARTS, _ENDS, _ANYWHERE, _OUTPUT, _VALUES, _TODO, _WRAPPER) for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"\\[sbwWdnt]", " ", p.pattern)))


def telling(word: str) -> bool:
    """A word some class rests on, or one with a mark that quotes or parts."""
    return not word.isalpha() and any(c in _PARTING for c in word) or any(w in _TELLING for w in _WORD.findall(word.lower()))


_KEYS = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
for _key in {*_START_KEYS, *_END_KEYS, *_MESSAGE_KEYS, *_OUTPUT_KEYS}:
    _KEYS.add_word(_key)
_KEYS.make_automaton()


def _may_tell(low: str) -> bool:
    """Whether a text in lower case has a part without which nothing in it is a message or output."""
    return next(_KEYS.iter(low), None) is not None or low.startswith(("at ", 'file "', "4", "5"))


def slots(text: str) -> list[str]:
    """Unfilled slots; none directly inside quotation marks, no markers of tokenizers."""
    out = []
    # a slot lies within a line, and has one of these marks
    for line in text.split("\n"):
        if not ("{" in line or "[" in line or "<" in line or "%" in line or "__" in line or "@@" in line):
            continue
        for m in _SLOTS.finditer(line):
            s = m.group()
            if s[0] == "<" and s[1] != "%" and (not (u := _UPPER_SLOT.fullmatch(s)) or u.group(1) in _MARKERS or s in ("<HTML>", "<BODY>")):
                continue
            if m.start() and line[m.start() - 1] in _OPENERS and line[m.end() : m.end() + 1] and line[m.end()] in _CLOSERS:
                continue
            out.append(s)
    return out


def lines_of(text: str) -> list[str]:
    return [x for line in (_TAGS.sub("\n", text) if "<" in text else text).split("\n") if (x := " ".join(line.split()))]


def masked(line: str) -> list[str]:
    """Words of a line, with masks for paths, hexadecimal strings and numbers."""
    if "/" in line:
        line = re.sub(r"(?:/[\w.-]+){2,}", "<path>", line)
    # hexadecimal strings have a digit, as masked words do
    return [w if w.isalpha() or not _DIGIT.search(w) else WILDCARD for w in line.split()] if _DIGIT.search(line) else line.split()


def leaf_of(words: list[str]) -> tuple:
    """Where the tree keeps the words: by their number, the first ``DEPTH`` ones and the last one."""
    return (len(words), *words[:DEPTH], *words[-1:])


class PrefixTree:
    """Message templates of lines, in leaves by ``leaf_of``."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[list[str]]] = {}

    def add(self, words: list[str]) -> list[str]:
        """The leaf's template for the words, changed in place as lines differ; telling words and quotation marks must agree."""
        leaf = self.leaves.setdefault(leaf_of(words), [])
        for t in leaf:
            differ = [i for i, (a, b) in enumerate(zip(t, words)) if a != b]
            if len(differ) <= (1 - SIMILAR) * len(words) and not any(telling(w) for i in differ for w in (t[i], words[i])):
                for i in differ:
                    t[i] = WILDCARD
                return t
        leaf.append(list(words))
        return leaf[-1]


def filler(line: str, words: int | None = None) -> bool:
    """Filler words all over or with next to nothing beside, a phrase of fillers, or one sentence said again and again."""
    low = line.lower()
    own = low.split()
    n = len(own) if words is None else words
    if len(_LOREM.intersection(own)) >= 3:
        said = _WORD.findall(low)
        of = sum(w in _LOREM for w in said)
        if len(said) >= 4 and (of >= 0.8 * len(said) or (of >= FILLER_WORDS and len(said) - of <= REST_WORDS)):
            return True
    first = _STOP.split(line, 1)[0].strip()
    if first and first != line and line.count(first) >= 2:
        said = [x.strip().lower() for x in _STOP.split(line) if x.strip()]
        if len(said) >= 2 and len(set(said)) == 1 and (len(said) > 2 or len(said[0].split()) <= 8):
            return True
    if any(k in low for k in _FILLER_KEYS) and not any(c in line for c in "“”„»«\""):
        return 0 < sum(len(m.group().split()) for m in _FILLER.finditer(line)) and n - sum(len(m.group().split()) for m in _FILLER.finditer(line)) <= FILLER_REST
    return False


def _head_class(template: str, ends: bool = True, told: bool | None = None) -> str:
    if len(template) <= 60 and _VALUES.match(template):
        return "value"
    if _TODO.match(template):
        return "todo"
    if _WRAPPER.match(template) or menu_items(template):
        return "wrapper"
    if told is False:
        return "content"
    low = template.lower()
    if told is None and not _may_tell(low):
        return "content"
    if (any(k in low for k in _OUTPUT_KEYS) or low.startswith(("at ", 'file "'))) and _OUTPUT.search(template):
        return "output"
    m = _STARTS.match(template) or (ends and any(k in low for k in _END_KEYS) and _ENDS.search(template)) or (any(k in low for k in _MESSAGE_KEYS) and _ANYWHERE.search(template)) or None
    if m and template.count("“", 0, m.start() + 1) <= template.count("”", 0, m.start() + 1) and not (m.start() and template[m.start() - 1] in _OPENERS):
        return "message"
    return "content"


def _running(words: list[str]) -> int:
    """Words that stand in runs of running text, that is in lower case on end."""
    total = run = 0
    for w in [*words, ""]:
        if w[:1].islower():
            run += 1
            continue
        total += run if run >= RUN_WORDS else 0
        run = 0
    return total


def classify(template: str) -> str:
    """message, output, value, todo, wrapper or content.

    A long line is judged by its first words and then sentence by sentence over its whole length: what follows the
    first words makes it a message or output if next to nothing else in it is running text.
    """
    words = template.split()
    told = _may_tell(template.lower())
    if len(words) <= HEAD_WORDS:
        return _head_class(template, told=told)
    if (kind := _head_class(" ".join(words[:HEAD_WORDS]), ends=False, told=told)) != "content" or not told:
        return kind
    found, rest = "", 0
    for sentence in _SENTENCES.split(template):
        kind = _head_class(sentence)
        said = sentence.split()
        if kind not in ("message", "output"):
            rest += len(said) if kind == "content" else 0
        else:
            found = found or kind
            if len(said) > HEAD_WORDS:
                # its last words may be the message's own
                rest += max(0, _running(said) - WINDOW_WORDS)
        if rest > REST_WORDS:
            return "content"
    return found or "content"


def wrapped_lines(lines: list[str]) -> set[int]:
    """Numbers of the neighbouring lines that only together are a message or output, over the whole text."""
    out: set[int] = set()
    if not _may_tell(" ".join(lines).lower()):
        return out
    for i, line in enumerate(lines[:-1]):
        past, j = 0, i + 1
        while j < len(lines) and past < WINDOW_WORDS and not _ENDED.search(lines[j - 1]):
            past += len(lines[j].split())
            joined = " ".join(lines[i : j + 1])
            kind = classify(" ".join(masked(joined))) if _may_tell(joined.lower()) else "content"
            if kind in ("message", "output"):
                # the least window only: none of its lines tells by itself, nor do they without the first one
                alone = [lines[j], " ".join(lines[i + 1 : j + 1]), line]
                if not any(classify(" ".join(masked(x))) in ("message", "output") for x in alone):
                    out.update(range(i, j + 1))
                break
            j += 1
    return out


def may_class(words: list[str]) -> bool:
    """Whether the words of a line can be anything but content: of those that can't, no template is."""
    name = " ".join(words)
    return _may_tell(name.lower()) or _head_class(name if len(words) <= HEAD_WORDS else " ".join(words[:HEAD_WORDS]), told=False) != "content"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that may be of a class, and one row without a line for the words of all others of such a text."""
    h = xxhash.xxh64_intdigest
    for b in batches:
        rows: list[tuple] = []
        for rid, text in zip(*(c.to_pylist() for c in b.columns)):
            slot = bool(slots(text))
            lines = lines_of(text)
            # a short text is also seen as one line, as its lines may be wrapped; in a longer one neighbouring lines are
            whole = " ".join(lines)
            wrapped = len(lines) > 1 and len(whole.split()) <= HEAD_WORDS
            joined = wrapped_lines(lines) if len(lines) > 1 and not wrapped else ()
            own: list[tuple] = []
            rest = 0
            for no, line in enumerate([*lines, *([whole] if wrapped else [])]):
                words = masked(line)
                n = len(words) - words.count(WILDCARD)
                one = line is whole and wrapped
                fill = no in joined or filler(line, n)
                counted = 0 if one or (line == lines[0] and n <= FIRST_WORDS) else n
                if fill or may_class(words):
                    own.append((rid, one, slot, fill, counted, words))
                else:
                    rest += counted
            if own or slot:
                rows += [*own, (rid, False, slot, False, rest, None)]
        names = [" ".join(r[5]) if r[5] else None for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.bool_()), pa.array([r[4] for r in rows], pa.int32()), pa.array([h(x) if x else None for x in names], pa.uint64()).cast(pa.int64(), safe=False), pa.array([h(" ".join(map(str, leaf_of(r[5])))) if r[5] else None for r in rows], pa.uint64()).cast(pa.int64(), safe=False), pa.array(names, pa.string())],
            names=["id", "whole", "slot", "fill", "words", "t", "leaf", "line"],
        )


def _verdicts(lines: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``(t, n, kind)`` of the lines ``(t, n, masked line)`` of one leaf whose template isn't content."""
    tree = PrefixTree()
    told: dict[int, str] = {}
    out = []
    for t, n, line in lines:
        template = id(tree.add(line.split(" ")))
        if template not in told:
            told[template] = classify(line)
        if told[template] != "content":
            out.append((t, n, told[template]))
    return out


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf by leaf; a leaf may reach over batches."""
    columns, leaf, lines = ["t", "n", "kind"], None, []
    for b in batches:
        out = []
        for f, t, n, line in zip(b["leaf"], b["t"], b["n"], b["line"]):
            if f != leaf:
                out += _verdicts(lines)
                leaf, lines = f, []
            lines.append((t, n, line))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(_verdicts(lines), columns=columns)


def residue(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, slot, n_residue, rest_words)`` of each text that is, or still holds, template residue or stands for an error.

    Null, empty and blank texts are none, nor are odd characters and markers of tokenizers. Whole texts are read, once;
    distinct lines are counted with map-side combining, so one that a third of all lines share costs a row a task, and its
    verdict comes back by a broadcast of checked size or a salted join. Rows repeated come out once for each id.
    """
    texts = df.filter(F.length(text) > 0).select(F.col(id_col).cast("long"), F.col(text))
    lines = written(spread(texts).mapInArrow(_lines, "id long, whole boolean, slot boolean, fill boolean, words int, t long, leaf long, line string"), "messages")
    told = lines.filter("line is not null")
    distinct = told.groupBy("t", "leaf", "line").agg(F.count(F.lit(1)).alias("n"))
    # each leaf whole and in order, so templates don't hang on how lines came
    leaves = distinct.repartition("leaf").sortWithinPartitions("leaf", "line")
    verdicts = written(leaves.mapInPandas(_classes, "t long, n long, kind string"), "verdicts")
    seen = keyed_join(told.drop("leaf", "line"), verdicts, ["t"], "n", F.col("id"), row_bytes=48, how="left")
    seen = seen.unionByName(lines.filter("line is null").drop("leaf", "line"), allowMissingColumns=True)
    bad = F.col("fill") | F.coalesce(F.col("kind") != "wrapper", F.lit(False))
    per = seen.groupBy("id").agg(
        F.max("slot").alias("slot"),
        F.count_if(bad & ~F.col("whole")).alias("n_residue"),
        F.max(bad & F.col("whole")).alias("as_one"),
        F.sum(F.when(F.col("kind").isNull() & ~F.col("fill") & ~F.col("whole"), F.col("words")).otherwise(0)).alias("rest_words"),
    )
    return per.filter(F.col("slot") | ((F.col("n_residue") > 0) & (F.col("rest_words") <= REST_WORDS)) | (F.col("as_one") & (F.col("rest_words") <= 2 * REST_WORDS))).select("id", "slot", "n_residue", "rest_words")
