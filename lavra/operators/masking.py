"""Consistent pseudonyms, hashes, noise and date shifts (PRJ-01..04, WIN-01, MSK-01..04, HSH-01, MTH-01, DAT-01, JN-06)."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import strip, zero_padded_code
from lavra.operators.numbering import number_rows
from lavra.operators.profile import parse_date

#: Prefix and digits of the codes of each category.
PREFIXES = {
    "equipamento": ("EQP", 3), "fabricante": ("FAB", 3), "local": ("LOC", 3), "usuario": ("USR", 3), "numero_serie": ("SN", 5), "numero_estoque": ("EST", 5),
    "modelo": ("MDL", 4), "part_number": ("PN", 5), "subsistema": ("SUB", 2), "grupo": ("GRP", 2), "tipo_equipamento": ("TEQ", 3), "unidade_superior": ("UNI", 3),
    "endereco": ("END", 4), "cep": ("CEP", 5), "sigla": ("SIG", 3), "area": ("AREA", 3), "regiao": ("REG", 3), "divisao": ("DIV", 3),
}
#: The same for spreadsheets.
SHEET_PREFIXES = {"equipamento": ("MAT", 3), "fabricante": ("FAB", 3), "local": ("LOC", 3), "usuario": ("USR", 3), "contrato": ("CTR", 3), "funds": ("FND", 3), "invoice": ("INV", 3)}
NOISE, SCALE, SEED = 0.05, 1.0, 42


def key_text(c: Column, kind: T.DataType | None = None) -> Column:
    """Text under which equal values share a code: trimmed, whole doubles without their decimals."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = c == F.floor(c)
        return F.when(F.isnan(c), None).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return strip(c.cast("string"))


def text_hash(c: Column) -> Column:
    """TXT_ and eight capital hex digits of the MD5 of the trimmed text; null stays null, blank stays blank (HSH-01)."""
    s = strip(c.cast("string"))
    return F.when(c.isNull(), None).when(s == "", c.cast("string")).otherwise(F.concat(F.lit("TXT_"), F.upper(F.substring(F.md5(s), 1, 8))))


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) that the parts alone decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def noisy_value(c: Column, row_key: Column, name: str, noise: float = NOISE, scale: float = SCALE, seed: int = SEED) -> Column:
    """value * scale * (1 + u), u uniform in [-noise, noise] by row and column; text that is no number gives null, so check the type first (MTH-01)."""
    number = c.try_cast("double")
    return F.round(number * F.lit(scale) * (1 + (2 * uniform(F.lit(seed), F.lit(name), row_key) - 1) * F.lit(noise)), 2)


def shifted_date(c: Column, days: int, kind: T.DataType) -> Column:
    """Dates and timestamps moved by whole days; ISO text becomes a timestamp, other text stays as it is (DAT-01)."""
    if isinstance(kind, T.DateType):
        return F.date_add(c, days)
    if isinstance(kind, T.StringType):
        at = parse_date(c, ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"))
        return F.coalesce((at + F.make_dt_interval(F.lit(days))).cast("string"), c)
    return c + F.make_dt_interval(F.lit(days))


@dataclass(frozen=True)
class Entity:
    """Pseudonym by category, shared by all columns and tables with that category."""

    category: str


@dataclass(frozen=True)
class Counter:
    """Pseudonym number by column name."""


Rule = Entity | Counter | str


def first_seen(values: DataFrame) -> DataFrame:
    """(category, key, first_at, ordinal): keys numbered within their category in the order they first appear (WIN-01).

    values: category, key, at; at is any orderable position. Ties in position are broken by the key.
    """
    seen = values.where("key is not null and key != ''").groupBy("category", "key").agg(F.min("at").alias("first_at"))
    return number_rows(seen, ["category"], ["first_at", "key"], "ordinal")


def dictionary(tables: list[tuple[DataFrame, str, dict[str, Rule]]], prefixes: dict[str, tuple[str, int]] = PREFIXES) -> DataFrame:
    """(category, key, ordinal, code) over all tables: (table, row order column, rules); a value has one code everywhere (MSK-01..03).

    Order of first appearance: table, column as listed in its rules, row.
    """
    parts = []
    for t, (df, order, rules) in enumerate(tables):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for i, (c, rule) in enumerate(rules.items()):
            if isinstance(rule, (Entity, Counter)) and c in kinds:
                category = rule.category if isinstance(rule, Entity) else f"_counter_{c}"
                at = F.struct(F.lit(t).alias("t"), F.lit(i).alias("c"), F.col(order).cast("string").cast("decimal(38,0)").alias("r"))
                parts.append(df.select(F.lit(category).alias("category"), key_text(F.col(c), kinds[c]).alias("key"), at.alias("at")))
    numbered = first_seen(reduce(DataFrame.unionByName, parts))
    prefix = F.create_map(*[F.lit(x) for k, (p, _) in prefixes.items() for x in (k, p)])
    digits = F.create_map(*[F.lit(x) for k, (_, d) in prefixes.items() for x in (k, d)])
    known = prefix[F.col("category")]
    code = F.when(F.col("category").startswith("_counter_"), F.col("ordinal").cast("string")).when(known.isNotNull(), zero_padded_code(known, F.col("ordinal"), digits[F.col("category")]))
    return numbered.select("category", "key", "ordinal", F.coalesce(code, zero_padded_code(F.upper(F.substring("category", 1, 3)), F.col("ordinal"), 3)).alias("code"))


def mask(df: DataFrame, rules: dict[str, Rule], codes: DataFrame | None = None, row_key: str | None = None, days: int = 365, noise: float = NOISE, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """df with one rule for each column: 'manter', 'texto_livre', 'valor', 'data', Entity(category) or Counter().

    Columns that the table lacks are skipped with a warning, unknown rules leave their column as it is with a warning.
    Entities: null stays null, blank becomes empty. Counters: null and blank become null.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    simple: dict[str, Callable[[str], Column]] = {
        "manter": F.col,
        "texto_livre": lambda c: text_hash(F.col(c)),
        "valor": lambda c: _value(c),
        "data": lambda c: shifted_date(F.col(c), days, kinds[c]),
    }

    def _value(c: str) -> Column:
        moved = noisy_value(F.col(c), F.col(row_key), c, noise, scale, seed)
        return F.coalesce(moved.cast("string"), F.col(c)) if isinstance(kinds[c], T.StringType) else moved

    out, plain = df, {}
    for c, rule in rules.items():
        if c not in kinds:
            warnings.warn(f"column {c} is not in the table", stacklevel=2)
        elif isinstance(rule, (Entity, Counter)):
            category = rule.category if isinstance(rule, Entity) else f"_counter_{c}"
            own = codes.where(F.col("category") == category).select(F.col("key").alias(f"__key_{c}"), F.col("code").alias(f"__code_{c}"))
            out = out.join(own, key_text(F.col(c), kinds[c]) == F.col(f"__key_{c}"), "left")
            blank = F.lit("") if isinstance(rule, Entity) else F.lit(None).cast("string")
            plain[c] = F.when(F.col(c).isNull(), None).when(key_text(F.col(c), kinds[c]) == "", blank).otherwise(F.col(f"__code_{c}"))
        elif rule in simple:
            plain[c] = simple[rule](c)
        else:
            warnings.warn(f"rule {rule!r} of column {c} is not known", stacklevel=2)
    return out.select(*[plain.get(c, F.col(c)).alias(c) for c in df.columns])


def composite_code(contract: Column, year: Column) -> Column:
    """{contract code}_MASK-{last two digits of the year} (MSK-04)."""
    return F.when(contract.isNotNull() & year.isNotNull(), F.concat(contract, F.lit("_MASK-"), F.right(year.cast("string"), F.lit(2))))


def remap(df: DataFrame, column: str, codes: DataFrame, key: str = "key", code: str = "code") -> DataFrame:
    """Foreign keys rewritten by a code table; unknown and blank ones stay (JN-06). The result is text."""
    c = codes.select(F.col(key).cast("string").alias("__k"), F.col(code).cast("string").alias("__c"))
    joined = df.join(c, strip(F.col(column).cast("string")) == F.col("__k"), "left")
    return joined.select(*[F.coalesce("__c", F.col(column).cast("string")).alias(column) if x == column else F.col(x) for x in df.columns])


def dictionary_json(codes: DataFrame) -> DataFrame:
    """{category: {key: code}} as one JSON document, for dictionaries that fit one file (SNK-05)."""
    inner = codes.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "code")))).alias("m"))
    return inner.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "m"))))).alias("document"))
