"""The ten operators against brute force, round trips and held-out labels, on small tables
with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import os
import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, contamination, gif, licenses, lines, neardup, quality, toxicity, urls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "One two\nthree  four"), (None, "one two three four five"), (5, LONG), (6, "é日😀 A\tb")]
SF = "/root/testdata/sf0.001"


def docs(spark, rows=EDGE, **extra):
    out = spark.createDataFrame([(k, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, (k, t) in enumerate(rows)], DOCS)
    for name, value in extra.items():
        out = out.withColumn(name, F.lit(value))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark", "conversations")}


def test_bpe_equals_tiktoken(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode_documents(docs(spark, key=1, n_tokens=2), path, P.PATTERN).join(docs(spark).dropDuplicates(["doc_id"]), "doc_id").collect():
        ids = want.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_gif_round_trip_and_frames(spark):
    for r in gif.read_payloads(gif.store_texts(docs(spark, media=b"x"))).join(docs(spark).dropDuplicates(["doc_id"]), "doc_id").collect():
        raw = (r["text"] or "").encode()
        raw += b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    stored = gif.decode_frames(gif.store_texts(docs(spark))).collect()
    assert all(sum(f["colours"]) == f["width"] * f["height"] for r in stored for f in r["frames"][:1])
    assert gif.decode_frames(spark.createDataFrame([(b"GIF89a",), (None,)], "media binary")).where("frames IS NOT NULL").count() == 0


def test_gif_disposal_and_transparency():
    def frame(indices, disposal, clear=None):
        flags = disposal << 2 | (clear is not None)
        return b"!\xf9\x04" + bytes([flags, 3, 0, clear or 0]) + b"\0," + bytes([0, 0, 0, 0, 2, 0, 2, 0, 0, 8]) + gif.blocks(gif.packed(gif.lzw_codes(bytes(indices))))

    head = b"GIF89a" + bytes([2, 0, 2, 0, 0xF7, 0, 0]) + bytes(x for v in range(256) for x in (v, v, v))
    shown = [c[..., 0].reshape(-1).tolist() for _, c in gif.rendered(head + frame([1, 2, 3, 4], 1) + frame([9, 7, 9, 9], 3, clear=9) + frame([9, 9, 5, 9], 2, clear=9) + frame([9, 9, 9, 6], 0, clear=9) + b";")]
    assert shown == [[1, 2, 3, 4], [1, 7, 3, 4], [1, 2, 5, 4], [0, 0, 0, 6]]


def test_url_rules_and_model(spark, tables):
    rows = [(1, None), (2, "no scheme"), (3, "https://A.Example.ORG/es/1"), (4, "http://example.org/en/12?x"), (5, "http://notexample.org/es/"), (6, "http://x.com/de/"), (7, "http://x.net/a"), (7, "http://x.net/a"), (8, "http://org")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id int, url string").withColumn("score", F.lit(1))).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[k]["rule"] for k in range(1, 9)] == [None, None, "example.org/es/", "example.org/en/1", "org/", "com/de/", None, None]
    assert (by[3]["host"], by[3]["path"], by[3]["verdict"], by[5]["verdict"]) == ("a.example.org", "/es/1", "block", "allow")
    assert urls.judge_urls(tables["pages"].limit(0)).count() == 0


def test_url_scores_equal_exact_counts(spark):
    """More distinct contexts and grams than any fixed number of slots that was used before."""
    rng, seen = random.Random(4), {"a": {}, "r": {}}
    rows = [(k, f"http://{['x.org/', 'x.com/de/', 'x.net/'][k % 3]}" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40))) for k in range(6000)]
    df = spark.createDataFrame(rows, "page_id int, url string")
    out = {r["page_id"] for r in df.where("pmod(xxhash64(url), 5) = 0").collect()}
    keys = lambda g: [(kind, k, g[4 - k : 4 + (kind == "g")]) for k in range(5) for kind in "gc"]
    grams = lambda u: [s[i : i + 5] for s in ["\x02" * 4 + u + "\x03"] for i in range(len(s) - 4)]
    for k, u in rows:
        if k % 3 < 2 and k not in out:
            for g in grams(u):
                for x in keys(g):
                    seen["ar"[k % 3]][x] = seen["ar"[k % 3]].get(x, 0) + 1
    assert len(set(seen["a"]) | set(seen["r"])) > 2 * 131_072

    def chance(name, g):
        p, own = 1 / 128, [seen[name].get(x, 0) for x in keys(g)]
        for k in range(5):
            p = (own[2 * k] + 2 * p) / (own[2 * k + 1] + 2)
        return p

    got = {r["page_id"]: r["score"] for r in urls.judge_urls(df).collect()}
    for k, u in rows[:300]:
        assert got[k] == pytest.approx(np.mean([np.log(chance("a", g)) - np.log(chance("r", g)) for g in grams(u)]), abs=1e-9)


def test_license_base_equals_brute_force(spark):
    rows = [*EDGE, (7, "Under the MIT  License, under the mit license; CC BY-NC."), (8, "cc by nc cc by nc Apache License, Version 2"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files")]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(docs(spark, rows, score=1)).collect()}
    want = set()
    for k, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.add((k, len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == want
    assert licenses.scan_licenses(docs(spark, rows)).where("doc_id = 9").first()["labels"] == "mit"


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|im_end|>", "&lt;|", "&amp;", "<", "|im_start|>assistant\n", "text ", "é", "\n"]
    rows = [(c, t, ["system", "user", "assistant", "a\nb", None][rng.randrange(5)], "".join(rng.choices(bits, k=rng.randrange(40))) if rng.random() < 0.9 else None) for c in (1, 2, None) for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_windows(chat.format_windows(df, 120, 40)).collect()}
    for c in (1, 2, None):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_near_duplicates_equal_brute_force(spark):
    rng, rows = random.Random(2), list(EDGE)
    for k in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for j in range(rng.randrange(1, 6)):
            own = [w if rng.random() > 0.02 * j else "x" + w for w in base]
            rows.append((100 + 10 * k + j, " ".join(own)))
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(docs(spark, rows), 2, 80).collect()}
    sets = [(k, set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()) for k, t in rows for w in [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(sets[i][0])
    want = {(sets[i][0], min((x for x in groups[find(i)] if x is not None), default=None), len(sets[i][1])) for i in range(len(rows))}
    assert got == want


def test_single_link_outsiders_of_a_large_group(spark):
    """Each outsider is similar enough to one member of a group of 1,500 near copies, and to no other."""
    rng, rows = random.Random(3), []
    base = [f"w{k}" for k in range(201)]
    for k in range(1500):
        own = base[:]
        for at in rng.sample(range(100), 4):
            own[2 * at] = f"m{k}x{at}"
        rows.append((k, " ".join(own)))
        if k % 10 == 0:
            for at in rng.sample([j for j in range(100) if own[2 * j] == base[2 * j]], 10):
                own[2 * at] = f"o{k}x{at}"
            rows.append((10_000 + k, " ".join(own)))
    got = neardup.near_duplicates(docs(spark, rows), 2, 80).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(0, len(rows))]


def test_lines(spark):
    rows = [(k, f"own {k}\nSame line\n\n {'pair' if k < 4 else 'rest'} ") for k in range(6)] + [(9, None), (10, "")]
    df = spark.createDataFrame([(k, t, "en", f"s{k}", 0) for k, t in rows], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.remove_boilerplate(df, min_sites=4).collect()}
    assert got[0] == (rows[0][1], 0) and got[5] == ("own 5\n\n rest ", 1) and got[3] == ("own 3\n", 2)
    assert got[9] == (None, 0) and got[10] == ("", 0)


def test_decontamination(spark, tables):
    items = [r["text"] for r in tables["benchmark"].orderBy("item_id").collect()]
    words = items[0].split()
    near = " ".join(w for k, w in enumerate(words) if k % 12 != 5)
    rows = [(1, None), (2, "clean " * 50), (3, f"before {items[1]} after"), (4, f"a b {near} c"), (4, f"a b {near} c"), (5, " ".join(reversed(words)))]
    got = {(r["doc_id"], r["item_id"]) for r in contamination.find_items(docs(spark, rows, item=1), tables["benchmark"]).collect()}
    first = tables["benchmark"].orderBy("item_id").limit(2).collect()
    assert {(3, first[1]["item_id"]), (4, first[0]["item_id"])} <= got and not any(k in (1, 2, 5) for k, _ in got)
    assert contamination.find_items(docs(spark, rows), tables["benchmark"].limit(0)).count() == 0


def test_edit_span():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 8)).astype("u8"), rng.integers(0, 4, rng.integers(0, 12)).astype("u8")
        d, a, z = contamination.edit_span(item, text)
        best = min(plain(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert d == best == plain(item, text[a:z])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_learned_scores(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels")}
    kept = quality.score_quality(t["documents"], t["labels"]).join(t["labels"], "doc_id").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in kept if bool(r["quality"]) == r["kept"]) / sum(r["count"] for r in kept)
    assert right > 0.95
    got = toxicity.score_toxicity(t["documents"], t["labels"]).where("held_out").join(t["labels"], "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.9


def test_learned_scores_on_edge_cases(spark, tables):
    none = tables["labels"].limit(0)
    assert quality.score_quality(docs(spark, _f=1), none).where("kept").count() == len(EDGE)
    got = toxicity.score_toxicity(docs(spark, _v=1), none).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)


def test_pipeline_steps_agree_with_brute_force(spark):
    """Each stage decides as its operator does alone, and the last row set follows from that."""
    import corpus_pipeline
    from tallyloom.llm.common import stash

    docs_now = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_now = stash(stage(spark, docs_now, SF))
        seen.append({r["doc_id"]: r["text"] for r in docs_now.collect()})
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:])) and seen[-1]
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for k, t in seen[1].items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert not any(a in seen[2] and b in seen[2] for a, b in linked)
    assert set(seen[1]) - set(seen[2]) <= {k for pair in linked for k in pair}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: want.encode_ordinary(t) for k, t in seen[3].items()}
    sites, first = {}, {}
    kept = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r["doc_id"] in seen[0]]
    for r in kept:
        for i, x in enumerate(r["text"].split("\n")):
            sites.setdefault(x.strip(), set()).add(r["source"])
            first.setdefault(x.strip(), (r["doc_id"], i))
    stays = lambda r, i, x: not x.strip() or len(sites[x.strip()]) < lines.MIN_SITES or first[x.strip()] == (r["doc_id"], i)
    cleaned = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if stays(r, i, x)) for r in kept}
    assert seen[1] == {k: t for k, t in cleaned.items() if t.strip() or t == seen[0][k]}
    items = [contamination.hashed(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(contamination.edit_span(x, contamination.hashed(t))[0] <= contamination.limit(len(x)) for x in items)
    assert set(seen[3]) == {k for k, t in seen[2].items() if not holds(t)}
    judged = {r["doc_id"]: r["kept"] for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(seen[0]) == {k for k, keep in judged.items() if keep}
