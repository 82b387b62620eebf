"""Problem 1: deeply nested catalog documents become related flat tables.

One pass: a depth-first visitor walks every document and emits (tag, primary key, parent key, payload) rows; the
emission is written once, partitioned by tag, and each tag is read back with its own schema. The tables are record, source,
sheet, column and foreign_key. Every `parent_pk` is the `pk` of a row of the record, source, sheet or column table, and
`branch` names the part of the parent that held the entry (columns, response, fields, sheets, foreign_keys). Nothing that a
document says is dropped: what has no field of its own, or not the field's type, is in `rest` as JSON.

Defined results: a null, empty, cut-off or otherwise unreadable document yields no rows; a byte order mark, padding,
text after the document and a document encoded once more as a JSON string are read through. Null entries yield no
rows. A part may be an object, a list or a single value. Repeated entries of a document are all emitted, `is_first`
marks one of each (kind, source, sheet, item). A null record_id is kept as null. Primary keys begin with the record_id and
a number of the delivered row, so rows with a null or repeated record_id have entries of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.session import materialize

EMISSION = "tag string, record_id bigint, pk string, parent_pk string, branch string, ordinal int, source_id string, sheet string, item string, is_first boolean, payload string, rest string"
_ARROW = pa.schema(
    [
        ("tag", pa.string()), ("record_id", pa.int64()), ("pk", pa.string()), ("parent_pk", pa.string()), ("branch", pa.string()), ("ordinal", pa.int32()),
        ("source_id", pa.string()), ("sheet", pa.string()), ("item", pa.string()), ("is_first", pa.bool_()), ("payload", pa.string()), ("rest", pa.string()),
    ]
)

#: Fields of each tag. What an entry holds beyond them, or in another type, goes to the table's `rest` as JSON.
PAYLOADS = {
    "record": "schema_version string, metadata string",
    "source": "description string, business_role string, when_to_use string, when_not_to_use string, embedding_hint string, path string, method string, filename string, "
    "row_count bigint, column_count int, response_format string, data_quality string",
    "sheet": "row_count bigint, column_count int, description string",
    "column": "type string, nullable boolean, is_pk boolean, null_rate double, cardinality bigint, min string, max string, mean double, description string, embedding_hint string",
    "foreign_key": "columns array<string>, references_table string, references_columns array<string>",
}
_NUMBERS = {"bigint": 63, "int": 31}
FIELDS = {tag: dict(f.split(" ") for f in schema.split(", ")) for tag, schema in PAYLOADS.items()}
#: The three source types with the container below each.
CONTAINERS = {"sql": "tables", "api": "endpoints", "spreadsheets": "files"}
#: What describes an entry; an entry of a list with nothing else has no name and is left out.
ATTRIBUTES = frozenset("type nullable null_rate cardinality description stats fields is_pk min max mean row_count column_count columns sheets foreign_keys data_quality path method filename response_schema business_role when_to_use when_not_to_use embedding_hint".split())
_DECODER = json.JSONDecoder(strict=False)


def parse(text: str | None) -> dict | None:
    """The document in text, or None where it is missing, cut off or not an object."""
    for _ in range(4):
        if not isinstance(text, str):
            break
        text = text.strip("﻿\x00 \t\r\n")
        if not text:
            return None
        try:
            text = _DECODER.raw_decode(text)[0]
        except (ValueError, RecursionError):
            return None
    return text if isinstance(text, dict) else None


def entries(part: object, *naming: str) -> Iterator[tuple[str, object]]:
    """(name, entry) pairs of a part shaped as object, list or single value; naming: the fields that may hold the name."""
    naming = naming or ("name",)
    if isinstance(part, dict):
        own = next((part[k] for k in naming if isinstance(part.get(k), str)), None)
        if own is not None and not isinstance(part.get("type"), (dict, list)):
            yield own, part
        else:
            yield from part.items()
    elif isinstance(part, list):
        for x in part:
            if not (isinstance(x, dict) and (any(k in x and not isinstance(x[k], str) for k in naming) or x.keys() <= ATTRIBUTES)):
                yield from entries(x, *naming)
    elif isinstance(part, (str, int, float)) and not isinstance(part, bool):
        yield str(part), {}


def _sources(part: object) -> Iterator[tuple[str, str, object]]:
    if isinstance(part, list):
        for x in part:
            yield from _sources(x)
    elif isinstance(part, dict):
        if isinstance(part.get("type"), str) and isinstance(part.get("key"), str):
            yield part["type"], part["key"], part
        else:
            for kind, below in part.items():
                inner = CONTAINERS.get(kind)
                if inner is None or below is None:
                    continue
                if isinstance(below, dict) and inner in below:
                    below = below[inner]
                for key, entry in entries(below, "key", "name"):
                    yield kind, key, entry


def _list(value: object) -> list[str]:
    if value is None:
        return []
    return [str(x) for x in value if x is not None] if isinstance(value, list) else [str(value)]


def _fits(kind: str, value: object) -> bool:
    if kind == "string":
        return True
    if kind == "boolean" or isinstance(value, bool):
        return kind == "boolean" and isinstance(value, bool)
    if kind in _NUMBERS:
        return isinstance(value, int) and -(1 << _NUMBERS[kind]) <= value < 1 << _NUMBERS[kind]
    return isinstance(value, (int, float)) if kind == "double" else isinstance(value, list)


def _told(tag: str, entry: dict, below: tuple[str, ...] = ()) -> tuple[str, str | None]:
    """(payload, rest) as JSON: the tag's own fields, and all else but the parts in `below`, which have rows of their own."""
    kinds, own, rest = FIELDS[tag], {}, {}
    for k, v in entry.items():
        if k in below:
            continue
        if k in kinds and _fits(kinds[k], v):
            own[k] = v
        elif v is not None:
            rest[k] = v
    return json.dumps(own, ensure_ascii=False), json.dumps(rest, ensure_ascii=False) if rest else None


def _payload(tag: str, name: str, entry: object) -> tuple[str, str | None]:
    if isinstance(entry, str) and tag == "column":
        entry = {"type": entry}
    elif not isinstance(entry, dict):
        entry = {"value": entry}
    entry = {k: v for k, v in entry.items() if not (k in ("name", "key") and v == name)}
    if tag == "source":
        response = entry.pop("response_schema", None)
        if isinstance(response, dict):
            response = {k: v for k, v in response.items() if k != "result_object_fields"}
            if isinstance(response.get("format"), str):
                entry["response_format"] = response.pop("format")
        if response:
            entry["response_schema"] = response
        return _told(tag, entry, ("columns", "fields", "sheets", "foreign_keys"))
    if tag == "column" and isinstance(entry.get("stats"), dict):
        stats = {**entry.pop("stats")}
        for k in ("min", "max", "mean"):
            if k in stats and k not in entry:
                entry[k] = stats.pop(k)
        if stats:
            entry["stats"] = stats
    return _told(tag, entry, ("columns", "fields") if tag == "sheet" else ("fields",) if tag == "column" else ())


def visit(record_id: int | None, document: dict, key: str | None = None) -> Iterator[tuple]:
    """Depth-first rows of one document, without is_first; key: what its primary keys begin with."""
    record = str(record_id) if key is None else key

    def columns(part: object, parent: str, branch: str, source: str, sheet: str) -> Iterator[tuple]:
        # an explicit stack, so that no depth of nesting is too deep
        stack = [(parent, branch, "", enumerate(entries(part)))]
        while stack:
            above, branch, prefix, rest = stack[-1]
            n, (name, entry) = next(rest, (-1, ("", None)))
            if n < 0:
                stack.pop()
            elif entry is not None:
                pk, item = f"{above}/{branch[0]}{n}", f"{prefix}{name}"
                yield "column", record_id, pk, above, branch, n, source, sheet, item, *_payload("column", name, entry)
                if isinstance(entry, dict) and entry.get("fields") is not None:
                    stack.append((pk, "fields", item + "/", enumerate(entries(entry["fields"]))))

    top = {("schema_version" if k == "_schema_version" else k): v for k, v in document.items()}
    yield "record", record_id, record, None, "", 0, "", "", "", *_told("record", top, ("sources",))
    for n, (kind, key, entry) in enumerate(_sources(document.get("sources"))):
        if entry is None:
            continue
        source, pk = f"{kind}.{key}", f"{record}:s{n}"
        yield "source", record_id, pk, record, "sources", n, source, "", "", *_payload("source", key, {k: v for k, v in entry.items() if k != "type" or v != kind} if isinstance(entry, dict) else entry)
        if not isinstance(entry, dict):
            continue
        yield from columns(entry.get("columns"), pk, "columns", source, "")
        response = entry.get("response_schema")
        if isinstance(response, dict):
            yield from columns(response.get("result_object_fields"), pk, "response", source, "")
        yield from columns(entry.get("fields"), pk, "fields", source, "")
        for m, (name, sheet) in enumerate(entries(entry.get("sheets"))):
            if sheet is None:
                continue
            sheet_pk = f"{pk}/h{m}"
            yield "sheet", record_id, sheet_pk, pk, "sheets", m, source, name, "", *_payload("sheet", name, sheet)
            if isinstance(sheet, dict):
                yield from columns(sheet.get("columns"), sheet_pk, "columns", source, name)
                yield from columns(sheet.get("fields"), sheet_pk, "fields", source, name)
        keys = entry.get("foreign_keys")
        for m, fk in enumerate(keys if isinstance(keys, list) else [keys]):
            if isinstance(fk, dict) and fk:
                own, ref = _list(fk.get("columns")), _list(fk.get("references_columns"))
                told = _told("foreign_key", {**fk, "columns": own, "references_columns": ref})
                yield "foreign_key", record_id, f"{pk}/k{m}", pk, "foreign_keys", m, source, "", f"{','.join(own)}>{fk.get('references_table') or ''}", *told


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for record_id, text, row in zip(*(c.to_pylist() for c in batch.columns)):
            document = parse(text)
            if document is None:
                continue
            seen: set[tuple] = set()
            for told in visit(record_id, document, f"{'' if record_id is None else record_id}.{row}"):
                case = (told[0], *told[6:9])
                rows.append((*told[:9], case not in seen, *told[9:]))
                seen.add(case)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def emit(records: DataFrame, id_column: str = "record_id", payload_column: str = "payload") -> DataFrame:
    """The tagged emission of every document; other columns of records are left out."""
    narrow = records.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(payload_column).alias("payload"), F.monotonically_increasing_id().alias("row"))
    return narrow.mapInArrow(_emit, EMISSION)


def flatten(records: DataFrame, id_column: str = "record_id", payload_column: str = "payload") -> dict[str, DataFrame]:
    """One DataFrame for each tag: keys and parent keys, names, and the tag's own fields.

    The emission is written once in the shared folder, partitioned by tag: a task appends to one file for each tag,
    so no shuffle is needed and a tag that holds most rows stays spread over all tasks.
    """
    written = materialize(emit(records, id_column, payload_column), "nested", ["tag"])
    keys = ["record_id", "pk", "parent_pk", "branch", "ordinal", "source_id", "sheet", "item", "is_first"]

    def typed(tag: str, schema: str) -> DataFrame:
        return written.where(F.col("tag") == tag).select(*keys, F.from_json("payload", schema).alias("p"), "rest").select(*keys, "p.*", "rest")

    return {tag: typed(tag, schema) for tag, schema in PAYLOADS.items()}


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_id, kind, source_id, sheet, item), each once, from the flat tables."""

    def case(tag: str) -> Column:
        return F.lit(tag).alias("kind")

    parts = [t.where("is_first").select("record_id", case(tag), "source_id", "sheet", "item") for tag, t in tables.items() if tag != "record"]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
