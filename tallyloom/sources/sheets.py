"""The nested sheet document: JSON text in, flat rows out."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(replies: Column) -> Column:
    """The first complete JSON object or list of a reply, as text: of its fenced block, if there is one, else from the first brace or
    bracket on; what follows it does not matter. Null without one."""

    def one(reply):
        if not isinstance(reply, str):
            return None
        text = reply.lstrip("\ufeff").strip()
        fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
        text = fence[1].strip() if fence else text
        starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
        if not starts:
            return None
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text[min(starts) :])[0], ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(one)

    return run(replies)


def salvaged(raw: Column) -> Column:
    """VARIANT of a reply: its fenced block, else the whole, else from the first brace to the
    last; null if none parses."""
    bare = F.regexp_replace(raw, "^﻿", "")
    fence = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    grab = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(F.nullif(fence, F.lit(""))), F.try_parse_json(bare), F.try_parse_json(F.nullif(grab, F.lit(""))))


def flatten_rows(docs: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """key, sheet_no, title, headers, row_no, row_type, cells, metadata. A sheet list may be
    the root; a row may be a bare list of cells."""
    root = docs.select(key, F.try_parse_json(json).alias("v"))
    sheets = F.coalesce(F.try_variant_get("v", "$.sheets", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    flat = root.select(key, F.posexplode(sheets).alias("sheet_no", "s"))
    name = lambda k: F.nullif(F.try_variant_get("s", f"$.{k}", "string"), F.lit(""))
    flat = flat.select(key, "sheet_no", F.coalesce(name("title"), name("name"), name("sheet_name"), F.lit("")).alias("title"), F.try_variant_get("s", "$.headers", "array<string>").alias("headers"), F.posexplode(F.try_variant_get("s", "$.rows", "array<variant>")).alias("row_no", "r"))
    cells = F.coalesce(F.try_variant_get("r", "$.data", "array<string>"), F.try_variant_get("r", "$", "array<string>"))
    kind = F.coalesce(F.try_variant_get("r", "$.row_type", "string"), F.lit("data"))
    return flat.select(key, "sheet_no", "title", "headers", F.col("row_no").cast("bigint").alias("row_no"), kind.alias("row_type"), cells.alias("cells"), F.try_variant_get("r", "$.metadata", "variant").alias("metadata"))


def padded(cells: Column, n: Column | int) -> Column:
    """Exactly n cells: cut, or filled with empty ones."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def row_text(headers: Column, cells: Column, skip: Sequence[str] = ()) -> Column:
    """Cells that are not blank, without those of output columns, joined by bars."""
    both = F.arrays_zip(headers.alias("h"), cells.alias("c"))
    kept = F.filter(both, lambda s: (F.trim(s["c"]) != "") & ~F.coalesce(s["h"].isin(*skip), F.lit(False)) if skip else F.trim(s["c"]) != "")
    return F.array_join(F.transform(kept, lambda s: s["c"]), " | ")


def contextual(title: Column, headers: Column, row: Column, n: int = 4) -> Column:
    """title | first headers | row, without blank parts."""
    return F.concat_ws(" | ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.array_join(F.slice(headers, 1, n), ","), F.lit("")), F.nullif(row, F.lit("")))
