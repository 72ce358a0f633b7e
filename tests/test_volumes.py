"""Pages, replies, vectors, results, the command line and links of workbooks."""

import json
import zipfile
import io

import pytest
from pyspark.sql import functions as F

from tallyloom import __main__ as cli
from tallyloom.sources import volumes as vo
from tallyloom.sources import workbook as wb


def test_pages_and_extraction(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("one\ftwo\fthree".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"x")
    pages = vo.read_pages(spark, str(tmp_path))
    assert sorted((r["doc"], r["page_no"], r["text"]) for r in pages.collect()) == [("a.TXT", 1, "one"), ("a.TXT", 2, "two"), ("a.TXT", 3, "three")]
    broken = vo.read_pages(spark, str(tmp_path), ".pdf", lambda data: data.no_such())
    assert broken.count() == 0

    def provider(text):
        return "no" if "three" in text else f'```json\n{{"sheets": [{{"title": "{text[:3]}", "rows": [["x"]]}}]}}\n```'

    docs, failed = vo.extract(pages.where("doc = 'a.TXT'"), provider, 1)
    sheets = json.loads(docs.first()["json"])["sheets"]
    assert [s["title"] for s in sheets] == ["one", "two"] and [(r["chunk_no"], r["reply"]) for r in failed.collect()] == [(2, "no")]


def test_vectors_are_cached_by_count(spark, tmp_path):
    path, calls = str(tmp_path / "v"), []

    def encode(df):
        calls.append(1)
        return df.withColumn("vector", F.array(F.lit(1.0)))

    index = spark.range(5)
    for rows in (index, index, spark.range(4)):
        assert vo.with_vectors(spark, path, rows, encode).count() == rows.count()
    assert len(calls) == 2


def test_config_and_runs(tmp_path):
    c = vo.Config.from_env({"TALLYLOOM_CHUNK_PAGES": "99", "TALLYLOOM_OUTPUT_TOKENS": "5", "TALLYLOOM_TOP_K": "x", "TALLYLOOM_MAY_OVERRIDE": "Yes", "TALLYLOOM_INCLUDE_JUNIPER": "0"})
    assert (c.chunk_pages, c.output_tokens, c.top_k, c.may_override, c.include_juniper) == (10, 1024, 8, True, False)
    out = str(tmp_path)
    assert [vo.new_run(out, "r").rsplit("/", 1)[-1] for _ in range(3)] == ["r", "r_1", "r_2"]
    (tmp_path / "r_1" / "x.json").write_text("1")
    assert vo.results(out) == [("r_1", "x.json")] and vo.inside(out, "r_1", "x.json").endswith("x.json")
    with pytest.raises(ValueError):
        vo.inside(out, "..", "x")
    assert vo.rounded({"a": [1.23456, True, "x", None]}) == {"a": [1.2346, True, "x", None]}


def test_workbook_links_and_hidden_columns():
    data = wb.write([{"title": "T", "headers": ["a", "References", "Reference_Match_Details"], "rows": [("data", ["https://no", "V: m - https://x/y.pdf | W", "{}"]), ("data", ["", None, ""])], "widths": [15, 20, 15]}])
    z = zipfile.ZipFile(io.BytesIO(data))
    sheet, rels = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/worksheets/_rels/sheet1.xml.rels").decode()
    assert 'ref="B2" r:id="rId1"' in sheet and sheet.count("<hyperlink ") == 1 and 'Target="https://x/y.pdf"' in rels and sheet.count('hidden="1"') == 1
    assert [c for _, _, c in wb.read(data)][1][0] == "https://no"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir(), (tmp_path / "docs").mkdir(), (tmp_path / "cat").mkdir()
    (tmp_path / "in" / "v.txt").write_text("\f".join(["intro"] * 4 + ["SECTION V\nfirewall switch router"] + ["firewall throughput gbps vpn " * 3] * 3 + ["BID FORMS"]))
    cli.main(["detect", str(tmp_path / "in"), str(tmp_path / "out.json")])
    assert json.loads((tmp_path / "out.json").read_text()) == [{"doc": "v.txt", "start_page": 5, "end_page": 8, "title": "SECTION V"}]
    cli.main(["cost", str(tmp_path / "in"), "--model", "gemini-2.5-pro"])
    assert "v.txt\tgemini-2.5-pro\t" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["cost", str(tmp_path / "in"), "--model", "none"])
    (tmp_path / "cat" / "fortinet.json").write_text(json.dumps([{"vendor": "Fortinet", "model": "FortiGate 40A", "category": "NGFW", "ipsec_vpn_throughput_gbps": 1}]))
    (tmp_path / "docs" / "d.json").write_text(json.dumps({"sheets": [{"title": "T", "headers": ["SN", "Requirement"], "rows": [["1", "Firewall appliance hardware, IPSec VPN throughput 200 Mbps capacity"]]}]}))
    cli.main(["match", str(tmp_path / "cat"), "Firewall, IPSec VPN throughput 200 Mbps"])
    assert "Fortinet: FortiGate 40A" in capsys.readouterr().out
    cli.main(["inject", str(tmp_path / "docs"), str(tmp_path / "cat"), str(tmp_path / "done")])
    doc = json.loads(spark.read.parquet(str(tmp_path / "done")).first()["json"])
    assert "Fortinet: FortiGate 40A" in doc["sheets"][0]["rows"][0]["data"][2]
