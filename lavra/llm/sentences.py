"""Problem 8: sentence units of texts in any script.

A text falls into blocks at blank lines, a block into list items and paragraphs. In a paragraph every mark that may end a
sentence (and in Thai every space) is a candidate. Semi-Markov dynamic programming picks the spans between candidates
whose scores sum highest. A span (i, j) is scored as a whole: the words that open it and what opens it against what closes it (a
question against a question mark), the words that close it, its length and whether it has a word of its own, and every
quotation or bracket that it opens without closing or closes without opening. Spans up to LONG characters are scored one by
one; of longer ones all terms but a linear length depend on few kinds of start, so a running maximum for each kind is exact.

Defined results: null, empty and blank texts have no units; offsets count code points of the text as given, with its own
line ends; a unit has no white space at either end. Any text of any length is split whole: a span may hold any
number of rejected candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, start_pos int, end_pos int"

#: Abbreviations that a name, a number or the rest of a phrase follows.
BEFORE = frozenset(
    "dr dra drs hptm oblt ltn obst gefr cdr kpt sr sra srta sres prof profa eng enga ing arq adv cap ten sgt sd cb cel maj maj gen brig alm cmte lt capt col mr mrs ms mx mme mlle mgr st ste "
    "dott sig av al pça trav rod r est art arts cf conf p pp pg pág págs pag fig figs sec sect sección cód cod ref refs núm num nr nº n.º no.º vs v vol cap inc "
    "aprox approx ca env abs abb anl tab kap nr z bzw vgl ggf inkl bspw hr fr frau dep sup depto dept ofic cia reg resp tel ed eds op ex ej exmo ilmo i.e e.g "
    "p.ex p.ej z.b d.h u.a v.a a.c bd rue ch г ул д кв р проф им т рис стр см тел κ κα π.χ χ σελ αρ δρ د أ م ص ت डॉ श्री श्रीमती प्रो सं पृ jan feb fev "
    "mar abr apr mai jun jul ago aug set sep sept out oct okt nov dez dec".split()
)
#: Those of them that only a number follows; before a capital letter they are words.
NUMBERED = frozenset("no art arts p pp fig figs sec sect nr abs abb tab kap cap v vol num núm s jan feb fev mar abr apr mai jun jul ago aug set sep sept out oct okt nov dez dec".split())
#: Abbreviations that may as well be the last word.
EITHER = frozenset("etc usw ltda cia s.a inc ltd co corp jr a.m p.m u.k u.s u.s.a d.c e.u ff ss шт гг др п κλπ κ.λπ st blvd ave rd".split())
#: Words before a single letter that names a thing rather than a person.
LETTERED = frozenset(
    "setor sector anexo anexos annex annexe apêndice apéndice appendix anlage grupo group groupe gruppe classe class clase seção section bloco block item ala lado turma "
    "tipo type typ fase phase plano plan sala room zona zone vitamina letra letter category categoria série serie parte part abteilung bereich sektor группа группы приложение ομάδα".split()
)
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
ORDINAL_AFTER = frozenset("am vom im der den dem das die zum beim des bis ab seit dieses jeder unser".split())
FILE_ENDINGS = frozenset("csv txt xlsx xls pdf doc docx json xml zip jpg png html htm ods odt ppt pptx py sql log md dat exe com org net gov br invalid local".split())
#: Words that often open a sentence, also where it is written in lower case.
OPENING = frozenset(
    "a o as os um uma em no na nos nas de do da ao às aos após antes já ontem hoje amanhã segundo conforme por pelo pela pelos quem quando onde como quanto quantos quantas qual quais durante "
    "restam vieram faltam falta foram há desde entre consta se não todos todas este esta esse essa "
    "the an at on in by per after before overnight yesterday today who where when why how what has have is are this that these it we they mr ms dr "
    "el la los las un una según tras quién dónde cuándo cuántas cuántos por quedan faltan ayer hoy "
    "le les l' d' selon après où qui sur combien cf il elle on nous der die das den am laut gemäß wer wo wann wie im in seit es ein eine".split()
)
#: Words that carry on after dots of omission or an abbreviation.
CARRY_ON = frozenset("mas porém e ou nem but yet and or pero y mais et aber und oder doch sondern но и а para for pour für zum".split())

#: Words with which a question begins.
ASKING = frozenset("quem quando onde como quanto quantos quantas qual quais quién dónde cuándo cuántas cuántos cuál qué who where when why how what which où qui combien wer wo wann wie warum кто где когда сколько".split())

#: What a span loses: by letter beyond LONG letters, without a word of its own, by candidate inside for each end of a quotation that it breaks.
LONG, PER_LETTER, WORDLESS, BREAK = 400, 0.004, 2.0, 4.0

#: Ends of listed words; a longer run of letters that ends otherwise is no abbreviation.
TAILS = frozenset(w[-4:] for w in BEFORE | NUMBERED | EITHER if len(w) > 3)

END = "!?。！？｡؟۔।॥።՞։…․.‼⁇⁈⁉;"
STRONG = frozenset("!?。！？｡؟۔।॥።։‼⁇⁈⁉")
CLOSERS = "\"”»’'›)]}」』）】〉》〕｣“"
OPENERS = "\"“«‘'‹([{「『（【〈《〔｢„¿¡—–-"
PAIRS = {"«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "‹": "›", "{": "}"}
CANDIDATE = re.compile(r"(?:[!?。！？｡؟۔।॥።։…․.‼⁇⁈⁉]+|;)[\"”»’'›)\]}」』）】〉》〕｣“]*")
THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
BLANK = re.compile(r"(?>\r\n|\r|\n)[^\S\r\n]*(?:(?>\r\n|\r|\n)[^\S\r\n]*)+")
LINE = re.compile(r"[^\r\n]+")
BULLET = re.compile(r"\s*([-*•‣◦▪–—·])\s+\S")
NUMBERING = re.compile(r"\s*(?:\(?\d{1,3}[.)]|\(?[a-z]\)|[A-Z]\)|\(?[ivx]{1,4}\)|[IVX]{2,4}[.)])\s+\S")
TOKEN_BACK = re.compile(r"[^\s\"“”«»()\[\]（）「」,;:!?¿¡]+$")
WORD = re.compile(r"[^\W\d_]+(?:'|’)?|\d+")
QUOTE = re.compile("[" + re.escape('"' + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
OPENED = re.compile(r"[\s\"“«‘'‹(\[{「『（【〈《〔｢„¿¡—–-]*")
LETTERS = re.compile(r"[^\W\d_]+")
LONG_WORD = re.compile(r"[^\W\d_]{6,}")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): list items, which stay whole, and paragraphs of one block.

    A list begins with its block, or inside it where two lines running have the same bullet; a line that a break in a
    paragraph merely makes look numbered is none.
    """
    lines = [(m.start(), m.end()) for m in LINE.finditer(text, a, b)]
    bullets = [m.group(1) if (m := BULLET.match(text, x, y)) else "" for x, y in lines]
    marked = [bool(t) or NUMBERING.match(text, x, y) is not None for t, (x, y) in zip(bullets, lines)]
    begin, item = a, False
    for k, (x, _) in enumerate(lines):
        twin = bullets[k] and k + 1 < len(lines) and bullets[k] == bullets[k + 1]
        if marked[k] and (k == 0 or item or twin):
            if x > begin:
                yield begin, x, item
            begin, item = x, True
    yield begin, b, item


class _Level:
    """A matched quotation or bracket: what breaking it costs with all around it, and the longest-span starts inside."""

    __slots__ = ("up", "depth", "end", "cost", "starts")

    def __init__(self, up: _Level | None, end: int, cost: float):
        self.up, self.end, self.starts = up, end, {}
        self.depth, self.cost = (up.depth + 1, up.cost + cost) if up else (0, 0.0)


def pairs(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(start, end) of matched quotations and brackets in order of their starts; unmatched ones don't count."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}
    for m in QUOTE.finditer(text, a, b):
        ch, i = m.group(), m.start()
        if ch == '"':
            before, after = (text[i - 1] if i > a else " "), (text[i + 1] if i + 1 < b else " ")
            if stack and stack[-1][0] == '"' and not (before.isspace() and not after.isspace()):
                out.append((stack.pop()[1], i))
            elif not after.isspace():
                stack.append(('"', i))
        elif ch in PAIRS and not (stack and ch == stack[-1][0]):
            stack.append((PAIRS[ch], i))
            waiting[PAIRS[ch]] = waiting.get(PAIRS[ch], 0) + 1
        elif waiting.get(ch):
            while stack[-1][0] != ch:
                lost, _ = stack.pop()
                if lost != '"':
                    waiting[lost] -= 1
            out.append((stack.pop()[1], i))
            waiting[ch] -= 1
    return sorted(out)


def _levels(found: list[tuple[int, int]], ends: list[int]) -> list[_Level]:
    """The innermost quotation or bracket around each end. Breaking one costs more than all cuts inside could earn."""
    top = _Level(None, ends[-1], 0.0)
    out, now, k = [], top, 0
    for x in ends:
        while now.up and now.end < x:
            now = now.up
        while k < len(found) and found[k][0] < x:
            start, end = found[k]
            k += 1
            if end >= x:
                inside = bisect_right(ends, end) - bisect_right(ends, start)
                now = _Level(now, end, BREAK * max(1, inside))
        out.append(now)
    return out


def _common(x: _Level, y: _Level) -> _Level:
    while x is not y:
        if x.depth >= y.depth:
            x = x.up
        else:
            y = y.up
    return x


def closing(text: str, a: int, m: re.Match) -> float:
    """How well the words before a mark close a sentence."""
    i, marks = m.start(), m.group().rstrip(CLOSERS)
    if marks == ";":
        return 4.0 if GREEK.search(text, max(a, i - 12), i) else -99.0
    if any(ch in STRONG for ch in marks):
        return 4.0
    if len(marks) > 1 or marks in "…․":
        return 1.0
    back = TOKEN_BACK.search(text, max(a, i - 40), i)
    if not back:
        return 3.0
    token = back.group()
    low = token.lower().lstrip("'’")
    before = text[max(a, back.start() - 64) : back.start()].rstrip(" \t\r\n")
    after = text[m.end() : m.end() + 1]
    nxt = _next_word(text, m.end(), len(text))
    if low in NUMBERED and not (nxt[:1].isdigit()):
        prior = WORD.findall(before[-24:])
        low_before = prior[-1].lower() if prior else ""
        if low == "s" and nxt[:1].isupper() and before.endswith("("):
            return -6.0
        if low in BEFORE and not (low in ("no",)):
            return -6.0 if len(low) < 3 and not low_before.isdigit() or nxt[:1].islower() or low in ("cap", "art", "abs", "abb", "fig", "sec", "vol", "tab", "kap", "núm", "num") else 0.5
        return 3.0
    if low in NUMBERED and nxt[:1].isdigit():
        return -6.0
    if low == "г" and re.search(r"\d$", before):
        return 1.0
    if low in ("m", "h", "p", "д", "р", "м", "s", "t", "a", "l", "g", "v") and token.islower() and re.search(r"\d$", before):
        return 3.0
    if len(low) == 1 and token.isalpha():
        if re.search(r"(?:^|[\s(])[A-Za-z]\.$", before) and token.isalpha() and (low, before[-2:].lower()) in (("b", "z."), ("h", "d."), ("e", "i."), ("g", "e."), ("a", "u."), ("е", "т."), ("д", "т."), ("п", "т.")):
            return -6.0
        prior = WORD.findall(before[-24:])
        if prior and (prior[-1].lower() in LETTERED):
            return 3.0
        if low in BEFORE and not token.isupper():
            return -6.0
        if token.isupper():
            return -1.5
        return 0.5 if token.islower() else 3.0
    if low in BEFORE:
        return -6.0
    if low in EITHER:
        return 0.7
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
        return -0.6
    if token.isdigit() and len(token) <= 2 and after.isspace():
        if nxt.lower() in MONTHS:
            return -6.0
        prior = WORD.findall(before[-16:])
        if prior and prior[-1].lower() in ORDINAL_AFTER and nxt[:1].isupper():
            return -6.0
    return 3.0


def _next_word(text: str, i: int, b: int) -> str:
    while i < b and (text[i].isspace() or text[i] in OPENERS):
        i += 1
    m = WORD.match(text, i, b)
    return m.group() if m else text[i : i + 1]


def opening(text: str, m: re.Match, b: int) -> float:
    """How well what follows a mark opens a sentence; -99 where nothing can."""
    i = m.end()
    if i >= b:
        return 9.0
    quoted = m.group()[-1] in "\"”»’'›」』“" and len(m.group().rstrip(CLOSERS)) < len(m.group())
    gap = text[i].isspace()
    j = i
    while j < b and text[j].isspace():
        j += 1
    if j >= b:
        return 9.0
    ch = text[j]
    if ch in ",;:、，；：" or (quoted and ch in "—–-"):
        return -99.0
    word = _next_word(text, j, b)
    low = word.lower()
    if len(word) == 1 and word.isupper() and text[j + 1 : j + 2] == ".":
        low = "\x00"  # an initial
    marks = m.group().rstrip(CLOSERS)
    if not gap:
        if WIDE.match(ch) or ch in "「『（【〈《“":
            if marks and marks[-1] in "…." and marks[-1] != "。":
                return -9.0
            return -9.0 if quoted and ch not in "「『（" else 1.0
        before = text[m.start() - 1 : m.start()]
        if marks == ".":
            if ch.isdigit() and (before.isdigit() or before.isalpha()):
                return -99.0
            if not ch.isalpha():
                return -99.0 if ch not in OPENERS else (1.0 if quoted or ch in "«“\"(¿¡" and before.isalpha() else -9.0)
            run = re.match(r"[\w.\-]+", text[j : j + 60]).group()
            left = re.search(r"[\w.\-@/]+$", text[max(0, m.start() - 60) : m.start()])
            left = left.group() if left else ""
            if re.match(r"[^\W\d]+", run).group().lower() in FILE_ENDINGS or "@" in left or "/" in left or "_" in left:
                return -99.0
            if re.match(r"[a-z0-9]+\.[a-z]", run) or re.search(r"[\w]\.[a-z]", left):
                return -99.0
            if ch.isupper():
                return (1.0 if low not in OPENING else 2.5) - (1.0 if len(before) and before.isupper() else 0.0)
            return -0.5 if low in OPENING else -4.0
        if ch.isalpha():
            return 1.0 if not quoted or ch.isupper() else -9.0
        if ch.isdigit():
            return 0.5
        return 0.5 if ch in OPENERS else -9.0
    if ch in OPENERS and ch not in "—–-":
        return 1.0 if not word[:1].islower() or word.lower() in OPENING else -1.0
    if word[:1].islower():
        if quoted:
            return -9.0
        if len(word) == 1 and text[j + 1 : j + 2] == "." and text[j + 2 : j + 4].strip()[:1].isupper() and text[m.start() - 2 : m.start()].isalnum():
            return -0.5  # an initial where sentences begin in lower case
        if low in CARRY_ON:
            return -3.5
        return -0.5 if low in OPENING else -2.0
    if ch.isdigit():
        return 0.8
    if not ch.isalpha():
        return 0.0
    if quoted and not ch.isupper():
        return -9.0  # scripts without case: the sentence goes on after its quotation
    return 2.5 if low in OPENING else 1.0


def _kind(text: str, i: int, b: int) -> int:
    """What opens a span: 1 an inverted question mark, 2 an inverted exclamation mark, 3 a word that asks, else 0."""
    m = OPENED.match(text, i, b)
    if "¿" in m.group() or "¡" in m.group():
        return 1 if "¿" in m.group() else 2
    word = WORD.match(text, m.end(), b)
    return 3 if word and word.group().lower() in ASKING else 0


def _agree(opened: int, mark: str) -> float:
    """How what opens a span agrees with the mark that closes it."""
    if opened == 3:
        return 0.6 if mark in "?？" else 0.0
    wanted = ("", "?", "!")[opened]
    return 0.0 if not wanted else 1.0 if mark == wanted else -1.5


def _has_word(text: str, i: int, j: int) -> bool:
    """Whether a span has a word of its own: one that is neither an abbreviation, a single letter nor a number."""
    if LONG_WORD.search(text, i, j):
        return True
    return any(t not in BEFORE and (len(t) > 1 or not t.isascii()) for t in (m.group().lower() for m in LETTERS.finditer(text, i, j)))


def candidates(text: str, a: int, b: int) -> list[tuple[int, float, str]]:
    """(end, score, mark) of every place inside text[a:b] where a sentence may end, by the words before and after it."""
    marks: list[tuple[int, float, str]] = []
    for m in CANDIDATE.finditer(text, a, b):
        x, y = m.start(), m.end()
        if y < b:
            if y - x == 1 and text[x] == "." and text[y].isspace() and text[y + 1 : y + 2].isupper() and text[y + 2 : y + 3].islower():
                tail = text[max(a, x - 4) : x]
                if len(tail) == 4 and tail.isalpha() and tail.islower() and tail not in TAILS:
                    # a plain word before and a plain word after: what closing() and opening() would say
                    marks.append((y, 5.5 if WORD.match(text, y + 1, b).group().lower() in OPENING else 4.0, "."))
                    continue
            score = closing(text, a, m)
            if score > -20:
                score += opening(text, m, b)
                if score > -20:
                    marks.append((m.end(), score, m.group().rstrip(CLOSERS)[-1:]))
    thai = [(m.start(), 2.0, " ") for m in THAI_GAP.finditer(text, a, b)]
    return sorted(marks + thai) if thai else marks


def split_paragraph(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Sentence spans of text[a:b], which holds no blank line."""
    marks = candidates(text, a, b)
    if not marks:
        return [(a, b)]
    ends = [a, *(x for x, _, _ in marks), b]
    last = CANDIDATE.findall(text, max(a, b - 8), b)
    gain = [0.0, *(s for _, s, _ in marks), 0.0]
    mark = ["", *(t for _, _, t in marks), last[-1].rstrip(CLOSERS)[-1:] if last else ""]
    kind = [_kind(text, x, b) for x in ends]
    level = _levels(pairs(text, a, b), ends)
    worded = [False, *(_has_word(text, ends[j - 1], ends[j]) for j in range(1, len(ends)))]
    best, back, near = [0.0] * len(ends), [0] * len(ends), 0
    for j in range(1, len(ends)):
        end, around = ends[j], level[j]
        while end - ends[near] > LONG:
            # this start and all before it make long spans from here on: only the best of its kind and level is kept
            home = level[near]
            while home.end < end and home.up:
                home = home.up
            value = best[near] - level[near].cost + PER_LETTER * ends[near]
            if home.starts.get(kind[near], (float("-inf"), 0))[0] < value:
                home.starts[kind[near]] = (value, near)
            near += 1
        top, at, own = float("-inf"), 0, False
        for i in range(j - 1, near - 1, -1):
            own = own or worded[i + 1]
            score = best[i] - level[i].cost + _agree(kind[i], mark[j])
            if level[i].cost:
                score += 2 * _common(level[i], around).cost
            if end - ends[i] < 4:
                score -= 1.5
            if not own:
                score -= WORDLESS
            if score > top:
                top, at = score, i
        home = around
        while home:
            for opened, (value, i) in home.starts.items():
                score = value + 2 * home.cost + _agree(opened, mark[j]) - PER_LETTER * (end - LONG)
                if score > top:
                    top, at = score, i
            home = home.up
        # quotations that end before the next end hand their starts to what is around them
        home = around
        while home.up and j + 1 < len(ends) and home.end < ends[j + 1]:
            for opened, (value, i) in home.starts.items():
                if home.up.starts.get(opened, (float("-inf"), 0))[0] < value:
                    home.up.starts[opened] = (value, i)
            home.starts, home = {}, home.up
        best[j], back[j] = top + gain[j] - around.cost, at
    spans, j = [], len(ends) - 1
    while j > 0:
        spans.append((ends[back[j]], ends[j]))
        j = back[j]
    return spans[::-1]


def split(text: str) -> list[tuple[int, int]]:
    """Sentence units of a text as code-point offsets, end exclusive."""
    out = []
    for a, b in blocks(text):
        a, b = _trim(text, a, b)
        if a >= b:
            continue
        for x, y, whole in pieces(text, a, b):
            x, y = _trim(text, x, y)
            for u, v in [(x, y)] if whole else split_paragraph(text, x, y):
                u, v = _trim(text, u, v)
                if u < v:
                    out.append((u, v))
    return out


_ARROW = pa.schema([("doc_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a, b in split(text) if text else ():
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_ARROW)


def sentences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos) of every unit; no shuffle, each row stands alone."""
    narrow = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(_units, SCHEMA)
