"""Problem 3: freely typed values are mapped to the entries of a reference list.

Both sides are folded (damaged encodings put right, case, accents, separators, remarks around the name). A multi-pattern
automaton over all canonical names and aliases then finds embedded mentions; the longest that don't overlap win. A mention
is taken where it is the whole value, or where the words around it are spellings of the same name or of no name. Remaining
values go to a similarity of token sets: each word is held against the indexed words of the names, and neighbouring words
run together, as the same, an abbreviation or a misspelling; entries of the same number or code are ranked by how much
of the value they cover. The nearest are then told apart letter by letter, in either order around a comma or dash: letters
that an abbreviation leaves out cost little, and less in a row at the end; letters that differ, that are missing at the start
of a word, or that the entry does not have cost much. The cheapest entry wins if it is cheap enough and clearly cheaper than the next.

Defined results: null and blank cells and cells that are exactly a canonical name of their field yield no row; a value
that names no entry, or several alike, gets ref_id 0. A number or code in the value that the entry does not have, or the
other way round unless the value is cut off, means another thing. Repeated rows each get their row.

Scale: distinct (field, value) pairs are counted out first, so every spelling is resolved once; the result joins back by
value, where Spark broadcasts it if it proves small and else splits skewed partitions. The token index is per field, so a
value is compared only with entries that share a word with it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

FIELDS = ("item", "nomenclatura_sigelog", "om_destino", "subsistema")
#: Entries that the driver reads and sends at a time; longer lists are read in blocks.
REFERENCE_ROWS = 200_000
#: Least likeness of two words, how near to the best token set an entry is looked at, and by how much the best must win.
ALIKE, NEARBY, MARGIN = 0.6, 0.45, 0.25
#: Part of a value that words of some entry must cover for the token sets to name the candidates, and the fewest letters.
COVERED, SHORT = 0.75, 6
#: Words that an entry may lack or have without meaning anything else.
LINKS = frozenset("de do da dos das e com para em a o of the and".split())

REMARKS = [
    (re.compile(r"\(\s*[a-z]{1,10}\s*\)?"), " "),
    (re.compile(r">+|<+|\.{3,}|…"), " "),
    (re.compile(r"\b\d+\s*un\b\.?"), " "),
    (re.compile(r"(?:^|(?<=[\s,\-]))(?:ref|cx)\s*[.:]+|(?:^|(?<=[\s,\-]))(?:kit|obs|cod|un)\s*[.:]+(?=\s|$)|(?:^|(?<=[\s,]))kit(?=\s|$)|^kit"), " "),
    (re.compile(r"[-/,]?\s*\bl+o*t+e*\s*\d+\b"), " "),
    (re.compile(r"[/\-]\s*n\.?f\.?\s*\d+|^\d+\s*,(?=.*/\s*nf\s*$)|/\s*nf\s*$"), " "),
    (re.compile(r"\bc\s*/\s*m[a-z]{2,8}\b"), " "),
    (re.compile(r"[-,]\s*u+r+g+[a-z]{0,8}\b|^u+r+g+[a-z]{0,6}\.?\s*,(?=.*-\s*$)"), " "),
]
CODE = re.compile(r"(?<![a-z0-9])([a-z]{2})\s?[-/ ]?\s?(\d{2,3})(?![a-z0-9])|([a-z]{2})\s?[-/]\s?(\d{2,3})(?![a-z0-9])")
NUMBER = re.compile(r"(?<![a-z0-9])(\d+)\s*(?:o\b\.?|a\b\.?|°|o(?=[a-z]))?")
MOJIBAKE = re.compile("[ÃãÂâ][\u0080-¿]")


def unbroken(text: str) -> str:
    """UTF-8 that was read as Latin-1, also where its case was changed afterwards, read again."""

    def again(m: re.Match) -> str:
        pair = m.group().replace("ã", "Ã").replace("â", "Â")
        try:
            return pair.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()

    return MOJIBAKE.sub(again, text)


def fold(text: str) -> str:
    text = re.sub("[¹²³¼½¾_]", " ", unbroken(text))
    text = unicodedata.normalize("NFKD", text).lower()
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", text).strip()


@dataclass
class Parsed:
    """A folded name: letters to align, where its words begin, and its code or number."""

    words: list[str]
    code: str = ""
    numbers: tuple[str, ...] = ()
    cut: bool = False
    swapped: list[str] | None = None


def parse(text: str, numbered: bool) -> Parsed:
    folded = fold(text)
    cut = folded.endswith(("...", "…"))
    for p, put in REMARKS:
        folded = p.sub(put, folded)
    code, numbers = "", []
    if numbered:
        numbers = [m.group(1) for m in NUMBER.finditer(folded)]
        folded = NUMBER.sub(" ", folded)
    else:
        m = None
        for m in CODE.finditer(folded):
            pass
        if m:
            code = "".join(g for g in m.groups() if g)
            folded = folded[: m.start()] + " " + folded[m.end() :]
        numbers = re.findall(r"\d+", folded)
    parts = re.split(r"\s*[,]\s*|\s+-\s+|\s+-(?=\s*$)", folded)
    parts = [p for p in (re.sub(r"[^a-z]+", " ", x).strip() for x in parts) if p]
    words = " ".join(parts).split()
    swapped = " ".join([parts[-1], *parts[:-1]]).split() if len(parts) > 1 else None
    return Parsed(words, code, tuple(str(int(x)) for x in numbers), cut, swapped)


@dataclass
class Entry:
    ref_id: int
    code: str
    numbers: tuple[str, ...]
    letters: str
    words: list[str] = field(default_factory=list)
    bag: Counter = field(default_factory=Counter)
    first: list[bool] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)


def entry_of(ref_id: int, name: str, numbered: bool) -> Entry:
    p = parse(name, numbered)
    out = Entry(ref_id, p.code, p.numbers, "".join(p.words), p.words, Counter("".join(p.words)))
    for w in p.words:
        out.first += [w not in LINKS] + [False] * (len(w) - 1)
        out.link += [w in LINKS] * len(w)
    return out


def begins_with_number(name: str | None) -> bool:
    return bool(name) and re.match(r"\s*\d+\s*[ºo°]", fold(name)) is not None


VOWELS = frozenset("aeiou")


def cost(v: str, e: Entry, limit: float) -> tuple[float, float]:
    """(whole cost, cost of letters that differ) of reading v as a way to write the entry."""
    letters, first, link = e.letters, e.first, e.link
    n = len(letters)
    drop = [0.04 if link[j] else 1.2 if first[j] else 0.12 if letters[j] in VOWELS else 0.2 for j in range(n)]
    inf = float("inf")
    prev = [(0.0, 0.0)]
    for j in range(n):
        prev.append((prev[-1][0] + drop[j], 0.0))
    prev2: list[tuple[float, float]] | None = None
    for i, x in enumerate(v):
        row = [((i + 1) * 1.0, (i + 1) * 1.0)]
        low = row[0][0]
        for j in range(n):
            y = letters[j]
            a = prev[j]
            if x == y:
                best = a
            else:
                best = (a[0] + 1.0, a[1] + 1.0)
            b = row[j]
            c = b[0] + drop[j]
            if c < best[0]:
                best = (c, b[1])
            c = prev[j + 1]
            if c[0] + 1.0 < best[0]:
                best = (c[0] + 1.0, c[1] + 1.0)
            if prev2 is not None and j and i and x == letters[j - 1] and v[i - 1] == y and x != y:
                c = prev2[j - 1]
                if c[0] + 0.9 < best[0]:
                    best = (c[0] + 0.9, c[1] + 0.9)
            row.append(best)
            if best[0] < low:
                low = best[0]
        if low > limit:
            return inf, inf
        prev2, prev = prev, row
    # what is left out at the end in one go is a cut, and cheap
    best = prev[n]
    tail = 0.0
    for j in range(n - 1, -1, -1):
        tail += 0.04 if not first[j] else 0.3
        c = prev[j][0] + tail + 0.3
        if c < best[0]:
            best = (c, prev[j][1])
    return best


def tokens_alike(v: str, t: str) -> float:
    """How well a typed word stands for a name's word: 1 the same, less for an abbreviation or a misspelling, 0 for neither."""
    if v == t:
        return 1.0
    if not v or not t:
        return 0.0
    if v[0] == t[0] and len(v) < len(t):
        rest = iter(t)
        if all(ch in rest for ch in v):
            return 0.9  # letters left out, inside or at the end
    if min(len(v), len(t)) < 3 or abs(len(v) - len(t)) > 3:
        return 0.0
    matcher = SequenceMatcher(None, v, t, autojunk=False)
    if matcher.real_quick_ratio() < ALIKE or matcher.quick_ratio() < ALIKE:
        return 0.0
    ratio = matcher.ratio()
    return ratio if ratio >= ALIKE else 0.0


class Mapper:
    """Resolves the values of one field against a list of entries.

    numbered: whether the field's names begin with a number; by default as most of these entries do.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], numbered: bool | None = None):
        import ahocorasick

        names = [n for _, n, _ in entries if n]
        self.numbered = bool(names) and sum(begins_with_number(n) for n in names) > len(names) / 2 if numbered is None else numbered
        self.entries = [entry_of(i, n, self.numbered) for i, n, _ in entries if n]
        self.exact: dict[str, set[int]] = defaultdict(set)
        for i, n, alias in entries:
            for x in (n, alias):
                if x and x.strip():
                    self.exact[self.plain(x)].add(i)
        self.automaton = ahocorasick.Automaton()
        for k, ids in self.exact.items():
            if k:
                self.automaton.add_word(f" {k} ", (k, ids))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.by_id = {e.ref_id: e for e in self.entries}
        # token index: words of the names, and neighbouring words run together, each with the entries that have them
        self.holders: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, e in enumerate(self.entries):
            for n in (1, 2, 3):
                for at in range(len(e.words) - n + 1):
                    self.holders["".join(e.words[at : at + n])].append((k, ((1 << n) - 1) << at))
        self.letters: dict[str, list[str]] = defaultdict(list)
        for t in self.holders:
            for ch in dict.fromkeys(t[:2]):
                self.letters[ch].append(t)
        self.alike: dict[str, dict[str, float]] = {}
        self.kinds: dict[tuple, frozenset[int]] = {}

    def plain(self, text: str) -> str:
        folded = fold(text)
        for p, put in REMARKS:
            folded = p.sub(put, folded)
        if self.numbered:
            folded = re.sub(r"(?<![a-z0-9])(\d+)\s*(?:o|a|°)?\b\.?\s*", r"\1 ", folded)
        else:
            folded = CODE.sub(lambda m: " " + "".join(g for g in m.groups() if g) + " ", folded)
        return re.sub(r"[^a-z0-9]+", " ", folded).strip()

    def like(self, word: str) -> dict[str, float]:
        """Indexed tokens that a typed word may stand for."""
        found = self.alike.get(word)
        if found is None:
            near = dict.fromkeys(t for ch in dict.fromkeys(word[:2]) for t in self.letters.get(ch, ()))
            found = {t: x for t in near if (x := tokens_alike(word, t))}
            if len(self.alike) < 500_000:
                self.alike[word] = found
        return found

    def mentions(self, plain: str) -> list[tuple[str, set[int]]]:
        """Longest mentions that do not overlap, found by the automaton."""
        if not len(self.automaton):
            return []
        padded, found = f" {plain} ", []
        for end, (k, ids) in self.automaton.iter(padded):
            found.append((end - len(k) - 1, end + 1, k, ids))
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int]] = []
        out = []
        for a, b, k, ids in found:
            if all(b - 1 <= s or a + 1 >= t for s, t in taken):
                taken.append((a, b))
                out.append((k, ids))
        return out

    def stands_alone(self, ref_id: int, mentioned: str, rest: list[str], p: Parsed) -> bool:
        """Whether a mention may be read without the words around it.

        They must bring no other number or code, and be words of the same name, however spelled, or words of no name at
        all. Beside a mere code, most of them must be words of its name.
        """
        e = self.by_id.get(ref_id)
        if e is None or (p.code and p.code != e.code) or (self.numbered and p.numbers != e.numbers) or (not self.numbered and p.numbers):
            return False
        if e.code and not p.code:
            return False
        own, foreign = 0, 0
        for w in rest:
            like = self.like(w)
            mine = any(self.entries[k] is e for t in like for k, _ in self.holders[t])
            if like and not mine or w.isdigit():
                return False
            own, foreign = own + mine, foreign + (not mine)
        return own >= max(1, foreign) if mentioned == e.code or not any(w in e.words for w in mentioned.split()) else True

    def read(self, text: str) -> tuple[str, int, float, float]:
        """(stage, ref_id, cost of the best, cost of the next): `name` and `embedded` by mention, `similar`, or `none`.

        For mentions the cost is minus their length, so that the longest of several lists wins.
        """
        plain = self.plain(text)
        parts = re.split(r"[,]| - ", fold(text), maxsplit=1)
        parsed = None
        for p in (plain, self.plain(" ".join(parts[::-1]))):
            found = self.mentions(p)
            if found:
                ids = set.intersection(*[i for _, i in found]) if len(found) > 1 else found[0][1]
                rest = f" {p} "
                for k, _ in found:
                    rest = rest.replace(f" {k} ", "  ", 1)
                rest = [w for w in rest.split() if w not in LINKS]
                if len(ids) == 1:
                    size, ref = -float(sum(len(k) for k, _ in found)), next(iter(ids))
                    if not rest:
                        return "name", ref, size, 0.0
                    parsed = parsed or parse(text, self.numbered)
                    if self.stands_alone(ref, found[0][0], rest, parsed):
                        return "embedded", ref, size, 0.0
        return self.similar(parsed or parse(text, self.numbered))

    def resolve(self, text: str) -> int:
        stage, ref, best, second = self.read(text)
        return ref if stage != "similar" or second - best >= MARGIN else 0

    def candidates(self, p: Parsed) -> list[Entry]:
        """Entries of the same number or code by token-set similarity: the closest, and all that come near them."""
        weight = lambda w: 0.1 if w in LINKS else float(len(w))
        kind = p.numbers if self.numbered else p.code
        if kind and kind not in self.kinds:
            self.kinds[kind] = frozenset(k for k, e in enumerate(self.entries) if (e.numbers if self.numbered else e.code) == kind)
        allowed = self.kinds[kind] if kind else None
        covered: dict[int, dict[int, float]] = defaultdict(dict)
        whole = 0.0
        for w in dict.fromkeys(p.words):
            whole += weight(w)
            for t, x in self.like(w).items():
                for k, mask in self.holders[t]:
                    if allowed is None or k in allowed:
                        own = covered[k]
                        gain = x * weight(w)
                        if gain > own.get(mask, 0.0):
                            own[mask] = gain
        if allowed is not None:
            for k in allowed:
                covered[k]
        scored = sorted(((min(whole, sum(own.values())) / (whole or 1.0), k) for k, own in covered.items()), reverse=True)
        if not scored or scored[0][0] < COVERED or whole < SHORT:
            # the value's words tell too little: entries by letters, which holds for words broken anywhere
            have = Counter("".join(p.words))
            lost = 2 + 0.25 * sum(have.values())
            among = self.entries if allowed is None else [self.entries[k] for k in allowed]
            return [e for e in among if sum((have - e.bag).values()) <= lost]
        bar = scored[0][0] - NEARBY
        return [self.entries[k] for x, k in scored if x >= bar]

    def similar(self, p: Parsed) -> tuple[str, int, float, float]:
        none = ("none", 0, float("inf"), float("inf"))
        v = "".join(p.words)
        if (len(p.numbers) != 1) if self.numbered else p.numbers:
            return none
        if not v or len(v) < 3 and not p.code:
            same = [e for e in self.entries if p.code and e.code == p.code] if not v else []
            return ("similar", same[0].ref_id, 0.0, float("inf")) if len(same) == 1 else none
        orders = [v] if p.swapped is None else ["".join(p.swapped), v]
        limit = 1.0 + 0.22 * len(v)
        scored = []
        for e in self.candidates(p):
            best = (float("inf"), float("inf"))
            for way in orders:
                best = min(best, cost(way, e, limit + 6))
            # a code that the value lacks is only left out where the value was cut off
            missing = bool(e.code) and not p.code
            scored.append((best[0] + (0.4 if missing else 0.0), best[1], e))
        if not scored:
            return none
        scored.sort(key=lambda x: x[0])
        whole, differs, e = scored[0]
        allowed = max(1.0, (0.22 if p.code or self.numbered else 0.18) * len(v)) if len(v) > 4 else (0.0 if len(v) < 4 else 1.0)
        known = bool(p.code) or self.numbered
        if self.numbered and len(v) > 8:
            allowed = 1.0 + 0.14 * len(v)
        if (
            differs > allowed + (1.0 if p.code and len(v) > 8 else 0.0)
            or whole > (2.2 if not known else 4.0) + 0.3 * len(v) ** 0.5 + differs
            or not known and whole > 2.5 and all(way[0] != e.letters[0] for way in orders if way)
            or not known and whole - differs > 0.55 * len(v) ** 0.75 + 1.0
        ):
            return ("none", 0, whole, float("inf"))
        return "similar", e.ref_id, whole, scored[1][0] if len(scored) > 1 else float("inf")


def distinct_values(rows: DataFrame, fields: tuple[str, ...], entries: DataFrame) -> DataFrame:
    """(campo, value) of all cells in question, each once."""
    cells = rows.select(*[F.col(c).cast("string").alias(c) for c in fields]).unpivot([], list(fields), "campo", "value")
    blank = F.length(F.trim(F.regexp_replace("value", r"[\s\u00A0]+", " "))) == 0
    canonical = entries.select("campo", F.col("canonical").alias("value")).distinct()
    return cells.where(F.col("value").isNotNull() & ~blank).groupBy("campo", "value").agg(F.count("*").alias("n")).join(canonical, ["campo", "value"], "left_anti").select("campo", "value")


def resolve(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(campo, value, ref_id, stage) of every distinct value.

    The list is read in blocks of REFERENCE_ROWS entries, by ref_id; every value is read against every block, and of all
    blocks the longest mention, else the most similar entry wins, as in one list.
    """
    spark = values.sparkSession
    listed = entries.where("campo is not null and canonical is not null").select("ref_id", "campo", "canonical", "alias")
    first = F.col("canonical").rlike(r"^\s*\d+\s*[ºoO°]").cast("int")
    numbered = {r["campo"]: r["share"] > 0.5 for r in listed.groupBy("campo").agg(F.avg(first).alias("share")).collect()}
    total = listed.count()
    count = max(1, -(-total // REFERENCE_ROWS))
    if count > 1:
        listed = materialize(listed.withColumn("block", F.pmod(F.xxhash64("campo", "ref_id"), F.lit(count))), "reference")
        values = materialize(values, "values")
    tasks = max(2, spark.sparkContext.defaultParallelism) * 2
    dealt = values.repartition(tasks, F.xxhash64("campo", "value"))
    if count > 1:
        dealt = materialize(dealt, "values")

    def against(part: DataFrame) -> DataFrame:
        by_field: dict[str, list[tuple[int, str, str | None]]] = defaultdict(list)
        for r in sorted(part.select("ref_id", "campo", "canonical", "alias").collect(), key=lambda r: r["ref_id"]):
            by_field[r["campo"]].append((r["ref_id"], r["canonical"], r["alias"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mappers: dict[str, Mapper] = {}
            for batch in batches:
                told = []
                for campo, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if campo not in mappers:
                        mappers[campo] = Mapper(by_field.get(campo, []), numbered.get(campo, False))
                    told.append(mappers[campo].read(value))
                cols = list(zip(*told)) if told else [[]] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.float64())))], names=["campo", "value", "stage", "ref_id", "best", "second"])

        return dealt.mapInArrow(run, "campo string, value string, stage string, ref_id bigint, best double, second double")

    told = against(listed)
    if count > 1:
        told = reduce(DataFrame.unionByName, [against(listed.where(F.col("block") == k)) for k in range(count)])
        one = F.struct(F.when(F.col("stage").isin("name", "embedded"), 0).otherwise(1).alias("order"), "best", "second", "ref_id", "stage")
        each = told.groupBy("campo", "value").agg(F.array_sort(F.collect_list(one)).alias("each")).withColumn("top", F.get("each", F.lit(0)))
        # the next best of all is the next of the best list or the best of another
        rival = F.get(F.filter("each", lambda x: (x["order"] == F.col("top.order")) & (x["ref_id"] != F.col("top.ref_id"))), F.lit(0))
        second = F.when(F.col("top.order") == 0, F.when(rival["best"] == F.col("top.best"), F.col("top.best")).otherwise(F.lit(float("inf")))).otherwise(F.least("top.second", F.coalesce(rival["best"], F.lit(float("inf")))))
        told = each.select("campo", "value", "top.stage", "top.ref_id", "top.best", second.alias("second"))
    near = F.col("second") - F.col("best") < MARGIN
    clear = (F.col("stage") != "none") & ~((F.col("stage") == "similar") & near) & ~(F.col("stage").isin("name", "embedded") & (F.col("second") == F.col("best")))
    return told.select("campo", "value", F.when(clear, F.col("ref_id")).otherwise(0).alias("ref_id"), F.when(clear, F.col("stage")).otherwise("none").alias("stage"))


def map_cells(rows: DataFrame, resolved: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, campo, ref_id) of every cell in question."""
    cells = rows.select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("string").alias(c) for c in fields]).unpivot([key], list(fields), "campo", "value")
    return cells.where(F.col("value").isNotNull()).join(resolved, ["campo", "value"]).select(key, "campo", "ref_id")
