"""Dictionary mapping of typed cells: exact, normalised, fuzzy, generated codes, and its reports (JN-01..05, MSK-05..13, AGG-10..14, STR-13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import code_number, is_blank, normalize_text, strip, year_suffix, zero_padded_code
from lavra.operators.numbering import number_rows
from lavra.session import materialize, parallelism

SUGGESTIONS = 3
#: Entries of a dictionary that the driver reads and sends at a time.
REFERENCE_ROWS = 200_000
#: The columns of the mapping job with the dictionary category of each.
MAPPING_PLAN = [
    ("invoice", "invoice"), ("contrato", "ID_CONTRATO_ANO"), ("acao", "funds"), ("item", "equipamento"), ("pn", "part_number"), ("nomenclatura_sigelog", "equipamento"), ("om_destino", "sigla"), ("rm_de_destino", "regiao"),
    ("subsistema", "subsistema"), ("tipoeqp", "tipo_equipamento"),
]


@dataclass(frozen=True)
class FuzzyRule:
    threshold: float
    inclusive: bool = False


#: How alike a value must be, by column.
FUZZY_RULES = {
    "invoice": FuzzyRule(0.85), "contrato": FuzzyRule(0.80), "acao": FuzzyRule(0.80), "item": FuzzyRule(0.80), "pn": FuzzyRule(0.87), "nomenclatura_sigelog": FuzzyRule(0.80),
    "om_destino": FuzzyRule(0.92, True), "subsistema": FuzzyRule(0.80), "tipoeqp": FuzzyRule(0.80),
}
DEFAULT_RULE = FuzzyRule(0.92, True)
#: Prefix, digits and year suffix of generated codes, by column.
GENERATED = {"invoice": ("INV", 3, False), "contrato": ("CTR", 3, True), "acao": ("FND", 3, False), "pn": ("PN", 5, False)}


def passes(score: Column, rule: FuzzyRule) -> Column:
    """Whether a score reaches the rule's threshold, itself included or not (PRJ-09)."""
    return score >= rule.threshold if rule.inclusive else score > rule.threshold


def lookup(mapping: DataFrame) -> DataFrame:
    """(key, norm, code, ord) with blank keys dropped; of equal keys the first stays (JN-02, JN-03). mapping: key, code, ord."""
    kept = mapping.select(strip(F.col("key")).alias("key"), "code", "ord").where("key != ''")
    first = kept.groupBy("key").agg(F.min_by("code", "ord").alias("code"), F.min("ord").alias("ord"))
    return first.select("key", normalize_text(F.col("key")).alias("norm"), "code", "ord")


def exact(values: DataFrame, refs: DataFrame) -> DataFrame:
    """values with code and stage: by the stripped key, else by the normalised key (JN-01). values: a column `value`."""
    by_key = refs.select(F.col("key").alias("__k"), F.col("code").alias("__c1"))
    by_norm = refs.groupBy("norm").agg(F.min_by("code", "ord").alias("__c2")).withColumnRenamed("norm", "__n")
    joined = values.join(by_key, strip(F.col("value")) == F.col("__k"), "left").join(by_norm, normalize_text(F.col("value")) == F.col("__n"), "left")
    stage = F.when(F.col("__c1").isNotNull(), "exact").when(F.col("__c2").isNotNull(), "normalized")
    return joined.select(*values.columns, F.coalesce("__c1", "__c2").alias("code"), stage.alias("stage"))


def _ratios(listed: list[tuple[str, str, str, int]], top: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        matcher = SequenceMatcher(None)
        for batch in batches:
            out: list[tuple] = []
            for value, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best: list[tuple] = []
                for key, ref, code, at in listed:
                    a, b = len(norm), len(ref)
                    # a ratio can't exceed twice the shorter length by the sum
                    bar = max(floor, best[-1][0] if len(best) == top else 0.0)
                    if not a + b or 2 * min(a, b) / (a + b) < bar:
                        continue
                    matcher.set_seqs(norm, ref)
                    if matcher.real_quick_ratio() < bar or matcher.quick_ratio() < bar:
                        continue
                    r = matcher.ratio()
                    if r >= bar:
                        best = sorted([*best, (r, at, key, code)], key=lambda x: (-x[0], x[1]))[:top]
                out += [(value, n + 1, key, code, r, at) for n, (r, at, key, code) in enumerate(best)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64()))], ["value", "place", "ref", "code", "score", "at"])

    return run


def fuzzy(values: DataFrame, refs: DataFrame, top: int = 1, floor: float = 0.0) -> DataFrame:
    """(value, place, ref, code, score): the most alike references of each distinct value by Ratcliff/Obershelp ratio (JN-04, JN-05, STR-13).

    Ties go to the first reference. The dictionary is read in blocks of REFERENCE_ROWS entries, and every value meets each
    as a stated query set, cut by an exact upper bound of the ratio. Nulls have no row.
    """
    asked = values.where("value is not null").select("value").distinct().select("value", normalize_text(F.col("value")).alias("norm"))
    asked = asked.repartition(2 * parallelism(values.sparkSession), "value")  # few small rows, but much work on each
    blocks = max(1, -(-refs.count() // REFERENCE_ROWS))
    dealt = refs.withColumn("__block", F.pmod(F.xxhash64("key", "ord"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        listed = [(r["key"], r["norm"], r["code"], r["ord"]) for r in sorted(dealt.where(F.col("__block") == k).collect(), key=lambda r: r["ord"])]
        parts.append(asked.mapInArrow(_ratios(listed, top, floor), "value string, place int, ref string, code string, score double, at bigint"))
    found = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        place = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("score"), "at"))
        found = found.withColumn("place", place).where(F.col("place") <= top)
    return found.drop("at")


def next_number(refs: DataFrame, prefix: str, digits: int) -> int:
    """One more than the highest number among codes with the prefix, 1 without any (STR-09)."""
    top = refs.agg(F.max(code_number(F.col("code"), prefix, digits)).alias("top")).first()["top"]
    return (top or 0) + 1


def generate(unmatched: DataFrame, start: int, prefix: str, digits: int, with_year: bool) -> DataFrame:
    """(norm, code): values that are alike once normalised share one new code, in order of first appearance (MSK-07, MSK-08).

    unmatched: value, at. The year suffix comes from the first spelling.
    """
    groups = unmatched.select("value", "at", normalize_text(F.col("value")).alias("norm")).groupBy("norm").agg(F.min(F.struct("at", "value")).alias("f"))
    ordered = number_rows(groups.select("norm", F.col("f.at").alias("at"), F.col("f.value").alias("value"), F.lit(0).alias("g")), ["g"], ["at", "norm"], "n")
    code = zero_padded_code(prefix, F.col("n") + (start - 1), digits)
    return ordered.select("norm", F.concat(code, year_suffix(F.col("value"))).alias("code") if with_year else code.alias("code"))


def cascade(rows: DataFrame, column: str, order: str, mapping: DataFrame, rule: FuzzyRule | None = DEFAULT_RULE, generated: tuple[str, int, bool] | None = None) -> DataFrame:
    """(value, first_at, occurrences, code, stage, score, ref) for every distinct non-blank value of a column (MSK-05).

    Stages in turn: exact, normalized, similarity, generated, else unmapped. Resolved on distinct values; join back by value.
    """
    refs = materialize(lookup(mapping), "lookup")
    values = rows.where(~is_blank(F.col(column))).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(order).alias("first_at"), F.count("*").alias("occurrences"))
    done = materialize(exact(values, refs), "exact")
    none = {"score": F.lit(None).cast("double"), "ref": F.lit(None).cast("string")}
    found = done.where("code is not null").withColumns(none)
    rest = done.where("code is null").drop("code", "stage")
    if rule is not None and not refs.isEmpty():
        near = fuzzy(rest, refs, 1, rule.threshold).where(passes(F.col("score"), rule)).select("value", F.col("code").alias("code"), F.round("score", 4).alias("score"), "ref")
        near = materialize(near, "similar")
        found = found.unionByName(rest.join(near, "value").withColumn("stage", F.lit("similarity")))
        rest = rest.join(near.select("value"), "value", "left_anti")
    if generated is not None:
        prefix, digits, with_year = generated
        new = generate(rest.select("value", F.col("first_at").alias("at")), next_number(refs, prefix, digits), prefix, digits, with_year)
        rest = rest.withColumn("norm", normalize_text(F.col("value"))).join(new, "norm").drop("norm").withColumn("stage", F.lit("generated")).withColumns(none)
    else:
        rest = rest.withColumn("code", F.lit(None).cast("string")).withColumn("stage", F.lit("unmapped")).withColumns(none)
    return found.unionByName(rest)


def apply(rows: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """rows with the column's values replaced by their codes; values without a code and blanks stay."""
    r = resolved.where("code is not null").select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    out = rows.join(r, F.col(column).cast("string") == F.col("__v"), "left")
    return out.select(*[F.coalesce("__c", F.col(column).cast("string")).alias(column) if c == column else F.col(c) for c in rows.columns])


def coverage(resolved: DataFrame, column: str) -> DataFrame:
    """Cells by stage and the mapped share in percent, 0 where there are none (AGG-10, MTH-14)."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("occurrences"))), F.lit(0))
    total = F.coalesce(F.sum("occurrences"), F.lit(0))
    mapped = total - of("unmapped")
    return resolved.agg(
        F.lit(column).alias("column_name"), total.alias("non_empty"), mapped.alias("mapped"), of("similarity").alias("by_similarity"), of("generated").alias("auto_coded"), of("unmapped").alias("unmapped"),
        F.when(total > 0, F.round(100 * mapped / total, 2)).otherwise(0.0).alias("pct_mapped"),
    )


def similarity_hits(resolved: DataFrame) -> DataFrame:
    """(value, ref, code, score, occurrences) of every value that was mapped by similarity (AGG-13)."""
    return resolved.where("stage = 'similarity'").select("value", "ref", "code", "score", "occurrences")


def unmapped(resolved: DataFrame) -> DataFrame:
    """(value, occurrences) that stayed without a code (AGG-11)."""
    return resolved.where("stage = 'unmapped'").select("value", "occurrences")


def contexts(rows: DataFrame, column: str, context: str, resolved: DataFrame) -> DataFrame:
    """(value, contexts): `context (n) | ...` by falling count, [vazio] for blank ones (AGG-12)."""
    ctx = F.when(is_blank(F.col(context)), "[vazio]").otherwise(strip(F.col(context).cast("string")))
    pairs = rows.join(unmapped(resolved).select(F.col("value").alias("__v")), F.col(column).cast("string") == F.col("__v"), "left_semi")
    counted = pairs.groupBy(F.col(column).cast("string").alias("value"), ctx.alias("ctx")).agg(F.count("*").alias("n"))
    shown = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "ctx")))
    text = F.transform(shown, lambda x: F.concat(x["ctx"], F.lit(" ("), (-x["neg"]).cast("string"), F.lit(")")))
    return counted.groupBy("value").agg(F.array_join(text, " | ").alias("contexts"))


def feedback(mapping: DataFrame, resolved: DataFrame) -> DataFrame:
    """The mapping with generated codes of new raw values appended (MSK-09). mapping: key, code, ord."""
    new = resolved.where("stage = 'generated'").join(mapping.select(F.col("key").alias("value")), "value", "left_anti")
    top = mapping.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("top")).first()["top"]
    numbered = number_rows(new.select("value", "code", "first_at", F.lit(0).alias("g")), ["g"], ["first_at", "value"], "n")
    return mapping.select("key", "code", "ord").unionByName(numbered.select(F.col("value").alias("key"), "code", (F.col("n") + top).alias("ord")))


def suggestions(resolved: DataFrame, mapping: DataFrame, top: int = SUGGESTIONS, floor: float = 0.0) -> DataFrame:
    """(value, occurrences, place, ref, code, score) for values that stayed unmapped (JN-05)."""
    if top < 1:
        raise ValueError("at least one suggestion")
    left = unmapped(resolved)
    return left.join(fuzzy(left, lookup(mapping), top, floor), "value")


def run_plan(
    rows: DataFrame, order: str, plan: list[tuple[str, str]], dictionaries: DataFrame, rules: dict[str, FuzzyRule] = FUZZY_RULES, generated: dict[str, tuple[str, int, bool]] = GENERATED, default: FuzzyRule = DEFAULT_RULE, context: str | None = "contrato"
) -> dict[str, DataFrame]:
    """rows, report, similar and unmapped of a plan [(column, category)] over dictionaries (category, key, code, ord) (MSK-06, MSK-12, AGG-10..13).

    Missing columns and empty categories appear in the report with status 'missing' and change nothing; columns with
    generated codes need no dictionary to begin with. `unmapped` holds each value's contexts and its best suggestion.
    """
    if not 0 <= default.threshold <= 1:
        raise ValueError("threshold must lie in 0..1")
    spark = rows.sparkSession
    have = {r["category"] for r in dictionaries.select("category").distinct().collect()}
    empty = "column_name string, non_empty bigint, mapped bigint, by_similarity bigint, auto_coded bigint, unmapped bigint, pct_mapped double"
    out, reports = rows, []
    similar = [spark.createDataFrame([], "column_name string, category string, value string, ref string, code string, score double, occurrences bigint")]
    left = [spark.createDataFrame([], "column_name string, value string, occurrences bigint, contexts string, ref string, score double")]
    for column, category in plan:
        if column not in rows.columns or category not in have and column not in generated:
            reports.append(spark.createDataFrame([(column, None, None, None, None, None, None)], empty).withColumn("status", F.lit("missing")))
            continue
        own = dictionaries.where(F.col("category") == category)
        resolved = materialize(cascade(rows, column, order, own, rules.get(column, default), generated.get(column)), "resolved")
        reports.append(coverage(resolved, column).withColumn("status", F.lit("mapped")))
        similar.append(similarity_hits(resolved).withColumns({"column_name": F.lit(column), "category": F.lit(category)}))
        seen = contexts(rows, column, context, resolved) if context in rows.columns else unmapped(resolved).select("value", F.lit(None).cast("string").alias("contexts"))
        best = suggestions(resolved, own, 1).select("value", "ref", F.round("score", 4).alias("score"))
        left.append(unmapped(resolved).join(seen, "value", "left").join(best, "value", "left").withColumn("column_name", F.lit(column)))
        out = apply(out, column, resolved)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return {"rows": out, "report": union(reports), "similar": union(similar), "unmapped": union(left)}
