"""Documents as pages, replies of an extractor, cached vectors and results: what comes in and goes out."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sheets as ss


@dataclass(frozen=True)
class Config:
    """Limits and switches; ``from_env`` reads TALLYLOOM_<NAME>, and numbers are kept within their bounds."""

    chunk_pages: int = 10
    output_tokens: int = 65_536
    top_k: int = 8
    candidates: int = 3
    include_juniper: bool = True
    may_override: bool = False

    BOUNDS = {"chunk_pages": (1, 10), "output_tokens": (1_024, 65_536), "top_k": (1, 1_000), "candidates": (1, 100)}

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f"TALLYLOOM_{f.name.upper()}")
            if raw is None:
                continue
            if isinstance(f.default, bool):
                out[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                continue
            low, high = cls.BOUNDS[f.name]
            try:
                out[f.name] = min(max(int(raw), low), high)
            except ValueError:
                out[f.name] = f.default
        return cls(**out)


def by_form_feed(data: bytes) -> list[str]:
    """Pages of a plain text: form feeds part them."""
    return data.decode("utf-8", "replace").split("\f")


def read_pages(spark: SparkSession, path: str, suffix: str = ".txt", parse: Callable[[bytes], list[str]] = by_form_feed) -> DataFrame:
    """doc (the file's name), page_no from 1, text of each file of a folder with the suffix, whatever its case. parse turns a file into
    its pages on an executor (a PDF library, say); a file that is empty or that it cannot read has no pages."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("doc"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, data in zip(b["doc"], b["content"]):
                try:
                    pages = parse(bytes(data))
                except Exception:
                    continue
                yield pd.DataFrame({"doc": [doc] * len(pages), "page_no": range(1, len(pages) + 1), "text": pages})

    return files.where(F.endswith(F.lower("doc"), F.lit(suffix.lower()))).mapInPandas(run, "doc string, page_no bigint, text string")


def chunks(pages: DataFrame, size: int = 10) -> DataFrame:
    """doc, chunk_no from 0, text: size pages each, counted from a document's first."""
    first = pages.groupBy("doc").agg(F.min("page_no").alias("_f"))
    rows = pages.join(first, "doc").withColumn("chunk_no", F.floor((F.col("page_no") - F.col("_f")) / size))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\f")
    return rows.groupBy("doc", "chunk_no").agg(text.alias("text"))


def extract(pages: DataFrame, provider: Callable[[str], str], size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sheets and failures. provider turns a chunk's text into a reply, on the executors; the first JSON value of a reply is taken.
    Sheets: doc_id, json ({"sheets": [...]}, the sheets of all chunks in order); failures: doc, chunk_no, reply of replies
    that hold none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "chunk_no": b["chunk_no"], "reply": [provider(t) for t in b["text"]]})

    replies = chunks(pages, size).mapInPandas(run, "doc string, chunk_no bigint, reply string")
    return combined(replies)


def combined(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheets and failures, as of ``extract``, of replies (doc, chunk_no, reply)."""
    read = replies.withColumn("v", F.try_parse_json(ss.first_value(F.col("reply"))))
    listed = F.coalesce(F.try_variant_get("v", "$.sheets", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    good = read.where(F.col("v").isNotNull()).withColumn("s", F.coalesce(listed, F.array().cast("array<variant>")))
    parts = F.transform("s", lambda x: F.to_json(x))
    texts = good.select("doc", "chunk_no", parts.alias("p")).groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "p"))), lambda c: c["p"])).alias("p"))
    docs = texts.select(F.col("doc").alias("doc_id"), F.concat(F.lit('{"sheets":['), F.array_join("p", ","), F.lit("]}")).alias("json"))
    return docs, read.where(F.col("v").isNull()).select("doc", "chunk_no", "reply")


def cached_vectors(spark: SparkSession, path: str, rows: int) -> DataFrame | None:
    """The vectors that a path holds, if there are as many as rows."""
    try:
        found = spark.read.parquet(path)
    except Exception:
        return None
    return found if found.count() == rows else None


def with_vectors(spark: SparkSession, path: str, index: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """encode(index), from the cache where it fits, else written there."""
    found = cached_vectors(spark, path, index.count())
    if found is None:
        encode(index).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def as_documents(rows: DataFrame) -> DataFrame:
    """doc_id, json: flat rows as the nested sheet document again, sheets and rows in order. A sheet's rows are one text
    in the end, so they are gathered."""
    row = F.to_json(F.struct("row_type", F.col("cells").alias("data")))
    sheets = rows.groupBy("doc_id", "sheet_no").agg(F.first("title").alias("title"), F.first("headers").alias("headers"), F.sort_array(F.collect_list(F.struct("row_no", row.alias("r")))).alias("r"))
    head = F.to_json(F.struct("title", "headers"))
    sheet = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"rows":['), F.array_join(F.transform("r", lambda x: x["r"]), ","), F.lit("]}"))
    sheets = sheets.withColumn("h", head).select("doc_id", "sheet_no", sheet.alias("s"))
    docs = sheets.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sheet_no", "s"))).alias("s"))
    return docs.select("doc_id", F.concat(F.lit('{"sheets":['), F.array_join(F.transform("s", lambda x: x["s"]), ","), F.lit("]}")).alias("json"))


def summary(rows: DataFrame, vendors: tuple[str, ...] = ("Fortinet", "Juniper")) -> DataFrame:
    """doc_id, sheet_no, title, row_no, description, and a column of references for each vendor, of the rows that have one."""
    parts = F.split("reference", r" \| ")
    own = lambda v: F.array_join(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{v}: "))), " | ")
    bare = lambda v: F.regexp_replace(own(v), rf"(^| \| ){v}: ", "$1")
    return rows.where(F.coalesce("reference", F.lit("")) != "").select("doc_id", "sheet_no", "title", "row_no", F.get("cells", description_column(F.col("headers"))).alias("description"), *(bare(v).alias(v.lower()) for v in vendors))


def description_column(headers: Column) -> Column:
    """Place of the first header that speaks of a description, requirement, specification, detail or text; else the second one."""
    words = r"(?i)description|requirement|specification|detail|text"
    at = F.array_position(F.transform(headers, lambda h: F.coalesce(h, F.lit("")).rlike(words)), True)
    return F.when(at > 0, at - 1).otherwise(F.least(F.lit(1), F.size(headers) - 1)).cast("int")


def datasheet_link(vendor: Column, model: Column, url: Column) -> Column:
    """An infographic of a FortiGate model stands for the datasheet of its series: hundreds of its number, and its letter."""
    n, letter = (F.regexp_extract(model, r"(?i)fortigate\s+(\d{3,4})([a-z])", k) for k in (1, 2))
    series = F.concat((F.floor(n.try_cast("int") / 100) * 100).cast("string"), F.lower(letter))
    swap = (F.lower(F.trim(vendor)) == "fortinet") & F.contains(F.lower(url), F.lit("infographic")) & (n != "")
    return F.when(swap, F.concat(F.lit("https://www.fortinet.com/content/dam/fortinet/assets/data-sheets/fortigate-"), series, F.lit("-series.pdf"))).otherwise(url)


def rounded(v, digits: int = 4):
    """Numbers of nested dicts and lists, rounded; flags and texts as they are."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return round(float(v), digits)
    if isinstance(v, dict):
        return {k: rounded(x, digits) for k, x in v.items()}
    return [rounded(x, digits) for x in v] if isinstance(v, list) else v


def new_run(out: str, name: str) -> str:
    """A folder of its own for a run on this machine: name, name_1, name_2, ..."""
    k = 0
    while True:
        path = os.path.join(out, name if not k else f"{name}_{k}")
        try:
            os.makedirs(path)
            return path
        except FileExistsError:
            k += 1


def results(out: str, suffix: str = ".json") -> list[tuple[str, str]]:
    """(run, file) of the newest file of each run under a folder, the newest run first."""
    found = []
    for run in os.scandir(out) if os.path.isdir(out) else ():
        files = [f for f in os.scandir(run.path) if f.is_file() and f.name.endswith(suffix)] if run.is_dir() else []
        if files:
            newest = max(files, key=lambda f: (f.stat().st_mtime, f.name))
            found.append((newest.stat().st_mtime, run.name, newest.name))
    return [(r, f) for _, r, f in sorted(found, reverse=True)]


def inside(out: str, run: str, name: str) -> str:
    """The path of a result; one that leads out of the folder is an error."""
    base = os.path.realpath(out)
    path = os.path.realpath(os.path.join(base, run, name))
    if os.path.commonpath([base, path]) != base or path == base:
        raise ValueError("a result lies within its folder")
    return path


def write_json(df: DataFrame, path: str) -> None:
    """Rows as pretty JSON lists on this machine, for results that a person reads; Spark's writer is for tables."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[\n")
        for k, r in enumerate(df.toLocalIterator()):
            f.write(("" if not k else ",\n") + json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2, default=str))
        f.write("\n]\n")
