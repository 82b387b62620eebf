"""Catalog context as Markdown and as selector prompts (REN-01..06, AGT-09, STR-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HINT_LENGTH, TYPE_LENGTH, EXAMPLE_LENGTH = 130, 20, 30


def column_lines(columns: DataFrame) -> DataFrame:
    """(source_id, column_lines): one Markdown table row for each column, types cut at 20 characters, nulls in whole percent."""
    line = F.format_string("| %s | %s | %s%% |", F.col("column_name"), F.substring("native_type", 1, TYPE_LENGTH), F.coalesce(F.round(F.col("null_rate") * 100, 0).cast("int").cast("string"), F.lit("?")))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", line.alias("line"))))
    return columns.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("column_lines"))


def source_blocks(sources: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(source_id, block): heading, description, role, use and columns of each source; missing counts show as ?."""
    if columns is not None:
        sources = sources.join(column_lines(columns), "source_id", "left")
    else:
        sources = sources.withColumn("column_lines", F.lit(None).cast("string"))

    def part(label: str, c: str):
        shown = F.col(c).isNotNull() & (F.trim(c) != "") & ~F.col(c).contains("[MANUAL]")
        return F.when(shown, F.concat(F.lit(f"**{label}:** "), F.trim(c)))

    rows = F.concat(F.lit("**Linhas:** "), F.coalesce(F.format_number("row_count", 0), F.lit("?")))
    where = F.when(F.col("path").isNotNull(), F.concat(F.lit("**Caminho:** "), F.coalesce("method", F.lit("GET")), F.lit(" "), F.col("path")))
    table = F.when(F.col("column_lines").isNotNull(), F.concat(F.lit("| coluna | tipo | nulos |\n|---|---|---|\n"), F.col("column_lines")))
    block = F.concat_ws("\n", F.concat(F.lit("### "), F.col("source_id")), part("Descrição", "description"), part("Papel", "business_role"), part("Usar quando", "when_to_use"), part("Não usar", "when_not_to_use"), where, rows, table)
    return sources.select("source_id", block.alias("block"))


def parameter_lines(parameters: DataFrame) -> DataFrame:
    """(source_id, parameter_lines): one row for each field of an endpoint's response, example cut at 30 characters (REN-03).

    parameters: source_id, ordinal, column_name, native_type, example.
    """
    example = F.when(F.length("example") > EXAMPLE_LENGTH, F.concat(F.substring("example", 1, EXAMPLE_LENGTH), F.lit("..."))).otherwise(F.coalesce("example", F.lit("")))
    line = F.format_string("| %s | %s | %s |", F.col("column_name"), F.substring(F.coalesce("native_type", F.lit("?")), 1, TYPE_LENGTH), example)
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", line.alias("line"))))
    return parameters.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("parameter_lines"))


def sheet_lines(sheets: DataFrame) -> DataFrame:
    """(source_id, sheet_lines): each sheet with its rows and columns (REN-04). sheets: source_id, ordinal, sheet, row_count, columns (array)."""
    line = F.format_string("- **%s** (%s linhas): %s", F.col("sheet"), F.coalesce(F.format_number("row_count", 0), F.lit("?")), F.array_join(F.coalesce("columns", F.array().cast("array<string>")), ", "))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "sheet", line.alias("line"))))
    return sheets.groupBy("source_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("sheet_lines"))


def full_blocks(sources: DataFrame, columns: DataFrame | None = None, parameters: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """(source_id, block): source_blocks() with the response fields of endpoints and the sheets of workbooks (REN-02..05)."""
    blocks = source_blocks(sources, columns)
    for made, heading, name in ((None if parameters is None else parameter_lines(parameters), "| campo | tipo | exemplo |\n|---|---|---|", "parameter_lines"), (None if sheets is None else sheet_lines(sheets), "**Planilhas:**", "sheet_lines")):
        if made is not None:
            more = F.when(F.col(name).isNotNull(), F.concat(F.lit(heading + "\n"), F.col(name)))
            blocks = blocks.join(made, "source_id", "left").select("source_id", F.concat_ws("\n", "block", more).alias("block"))
    return blocks


def compressed_lines(sources: DataFrame) -> DataFrame:
    """(source_id, line): id and the first 130 characters of the hint, else of the description (REN-05)."""
    text = F.coalesce(F.when(F.trim("embedding_hint") != "", F.trim("embedding_hint")), F.col("description"), F.lit(""))
    return sources.select("source_id", F.concat(F.lit("- "), F.col("source_id"), F.lit(": "), F.substring(text, 1, HINT_LENGTH)).alias("line"))


def context(query: str, blocks: DataFrame, selected: list[str] | None = None, rules: list[tuple[str, str]] = ()) -> str:
    """Markdown of the selected blocks, or of all; made on the driver from a catalog's few sources (REN-01).

    rules: (name, text) of the rules that selected the sources; the footer names them and how many of all sources were taken.
    """
    every = blocks.orderBy("source_id").collect()
    rows = [r for r in every if selected is None or r["source_id"] in set(selected)]
    footer = [f"---\n{len(rows)} de {len(every)} fontes" if selected is not None else f"---\n{len(rows)} fontes"]
    if rules:
        footer.append("**Regras aplicadas:**\n" + "\n".join(f"- {name}: {text}" for name, text in rules))
    return "\n\n".join([f"# Contexto\n\n> {query}", *[r["block"] for r in rows], *footer])


def system_prompt(lines: DataFrame) -> str:
    """Selector prompt over the catalog, compressed (compressed_lines) or full (full_blocks)."""
    column = "line" if "line" in lines.columns else "block"
    listed = "\n".join(r[column] for r in lines.orderBy("source_id").collect())
    return 'Escolha as fontes que respondem à pergunta. Responda só com JSON: {"sources": ["tipo.chave"]}.\n\n' + listed


def schema_prompt(source_id: str, df: DataFrame) -> str:
    """Name and columns of one source for a query writer (AGT-09)."""
    return f"{source_id}(" + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ")"


def synthesis_report(original: dict[str, DataFrame], made: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, synthetic_rows, columns) (REN-06)."""
    out = None
    for name, df in original.items():
        part = df.agg(F.count("*").alias("rows")).join(F.broadcast(made[name].agg(F.count("*").alias("synthetic_rows")))).select(F.lit(name).alias("table"), "rows", "synthetic_rows", F.lit(len(df.columns)).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out
