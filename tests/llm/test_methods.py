"""The methods of the operators against plain versions: codecs, votes, windows, joins, models."""

import collections
import math
import random
import re
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat, contamination, gif, licenses, lines, neardup, quality, toxicity, urls

from .test_operators import DOCS, EDGE, LONG, docs


# GIF


def plain_lzw(indices, bits, clears=True):
    """Codes with their widths, by the textbook; without clears a full table stays."""
    clear = 1 << bits
    out, table, width, word = [], {}, bits + 1, ()

    def begin():
        table.clear()
        table.update({(k,): k for k in range(clear)})

    begin()
    out.append((clear, width))
    free = clear + 2
    for x in indices:
        if (*word, x) in table:
            word = (*word, x)
            continue
        out.append((table[word], width))
        if free < 4096:
            table[*word, x] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        elif clears:
            out.append((clear, width))
            begin()
            width, free = bits + 1, clear + 2
        word = (x,)
    out.append((table[word], width))
    if free == 1 << width and width < 12:
        width += 1
    out.append((clear + 1, width))
    value, at = 0, 0
    for code, width in out:
        value |= code << at
        at += width
    return value.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("bits", [2, 4, 8])
@pytest.mark.parametrize("clears", [True, False])
def test_lzw_reads_textbook_streams(bits, clears):
    rng = random.Random(bits)
    for n in (1, 5, 300, 20_000):
        data = [min(int(rng.expovariate(0.4)), (1 << bits) - 1) for _ in range(n)]
        assert gif.lzw(plain_lzw(data, bits, clears), bits, n).tolist() == data


def test_lzw_writes_what_the_textbook_reads():
    rng = random.Random(5)
    for n in (64, 20_032):
        data = bytes(rng.choice(b"etaoin shrdlu\0") for _ in range(n))
        runs = gif.lzw_codes(data)
        assert max(len(r) for r in runs) <= 3839 and sum(len(r) for r in runs) < n
        assert gif.lzw(gif.packed(runs), 8, n).tobytes() == data


def image(w, h, data, flags=0, palette=b"", bits=2, control=b""):
    return control + b"," + struct.pack("<HHHHB", 0, 0, w, h, flags) + palette + bytes([bits]) + gif.blocks(plain_lzw(data, bits))


def test_interlace_local_palettes_and_broken_files(spark):
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 9, 0x81, 0, 0) + bytes(range(12))
    rows = [[k % 4, (k + 1) % 4] for k in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    local = bytes(x for k in range(4) for x in (200 + k, 100, 50))
    control = b"!\xf9\x04\x00" + struct.pack("<HB", 7, 0) + b"\0"
    file = head + image(2, 9, [x for k in order for x in rows[k]], flags=64) + image(2, 9, [x for r in rows for x in r], flags=0x81, palette=local, control=control) + b";"
    frames = [(f, c.copy()) for f, c in gif.rendered(file)]
    assert frames[0][0]["indices"].tolist() == frames[1][0]["indices"].tolist() == rows
    assert frames[0][1][3, 0].tolist() == [9, 10, 11, 255] and frames[1][1][3, 0].tolist() == [203, 100, 50, 255]
    assert frames[1][0]["delay_cs"] == 7
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6)
    broken = [huge + image(2, 9, [0] * 18) + b";", huge[:6] + struct.pack("<HH", 2, 9) + huge[10:] + b"," + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02" + gif.blocks(plain_lzw([0] * 18, 2)) + b";", head + image(2, 9, [0] * 17) + b";", file[:60], b"", None]
    got = gif.decode_frames(spark.createDataFrame([(k, b) for k, b in enumerate([file, *broken])], "k int, media binary").withColumn("frames", F.lit(1))).orderBy("k").collect()
    assert [f["start_cs"] for f in got[0]["frames"]] == [0, 0] and all(r["frames"] is None for r in got[1:])
    read = gif.read_payloads(spark.createDataFrame([(1, 0, b) for b in broken], "doc_id int, n_bytes bigint, media binary")).collect()
    assert len(read) == len(broken) and all(r["payload_sha256"] is None for r in read)


def test_feature_counts_the_colours_that_are_shown(spark):
    raw = bytes(range(256))
    row = gif.read_payloads(spark.createDataFrame([(1, 256, gif.encode(raw))], "doc_id int, n_bytes bigint, media binary")).first()
    want = collections.Counter(int(r) // 64 * 16 + int(g) // 64 * 4 + int(b) // 64 for r, g, b in gif.CUBE)
    assert row["feature"] == "1f4cs:" + "-".join(f"{k}:{n}" for k, n in sorted(want.items()))


# Lines


def test_lines_keep_clashing_columns(spark):
    rows = [(k, "Same\nown " + str(k), "en", f"s{k}", 0) for k in range(5)] + [(9, None, None, None, None), (4, "Same\nown 4", "en", "s4", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("_gone", "_k", "_h", "_x", "_j", "N_lines", "_gone_"):
        df = df.withColumn(name, F.lit(7))
    got = lines.remove_boilerplate(df, min_sites=3)
    assert {"_gone", "_k", "_h", "_x", "_j", "_gone_"} <= set(got.columns) and got.columns.count("n_lines") == 1
    by = sorted((r["doc_id"], r["text"], r["n_removed"], r["_gone"]) for r in got.collect() if r["doc_id"] != 9)
    assert by[0] == (0, "Same\nown 0", 0, 7) and by[-2:] == [(4, "own 4", 1, 7)] * 2
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(f"l{int(rng.expovariate(0.15))}" for _ in range(rng.randrange(1, 40))), "en", rng.choice(["a", "a", "a", *"bcdefghijklm", None]), 0) for k in range(300)]
    rows.append((1000, "\n".join(["l1"] * 4000 + ["own"] * 4000), "en", "z", 0))
    sites, first = collections.defaultdict(set), {}
    for k, t, _, s, _ in rows:
        for i, x in enumerate(t.split("\n")):
            sites[x].add(s)
            first.setdefault(x, (k, i))
    got = {r["doc_id"]: r["text"] for r in lines.remove_boilerplate(spark.createDataFrame(rows, DOCS), min_sites=10).collect()}
    for k, t, *_ in rows:
        assert got[k] == "\n".join(x for i, x in enumerate(t.split("\n")) if len(sites[x]) < 10 or first[x] == (k, i))


# Licenses


def plain_spans(text):
    """Labels of verified spans: k-grams by diagonals in plain loops."""
    words, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), set()
    for phrase, label, *must in [*licenses.BASE, *licenses.TEMPLATES]:
        p, need = phrase.split(), "".join(must).split()
        hits = collections.defaultdict(set)
        for i in range(len(words) - 2):
            for j in range(len(p) - 2):
                if words[i : i + 3] == p[j : j + 3]:
                    hits[i - j].add(j)
        runs, last = [], None
        for d in sorted(hits):
            if must and last is not None and d - last <= licenses.SLACK:
                runs[-1] |= hits[d]
            else:
                runs.append(set(hits[d]))
            last = d
        for run in runs:
            held = {j + x for j in run for x in range(3)}
            told = not need or any(p[j : j + 3][x : x + len(need)] == need and j + x == next(i for i in range(len(p)) if p[i : i + len(need)] == need) for j in run for x in range(3))
            if len(held) == len(p) if not must else len(held) >= min(licenses.LEAST, len(p)) and len(held) >= licenses.COVER * (max(held) - min(held) + 1) and told:
                found.add(label)
    return ",".join(sorted(found))


def test_license_spans_equal_brute_force(spark):
    rng, rows = random.Random(6), [(1, None), (2, ""), (3, "this work is licensed under CC BY-NC."), (4, "Licensed under CC-BY-SA"), (5, LONG), (5, LONG)]
    for k in range(120):
        words = rng.choice(licenses.TEMPLATES)[0].split()
        a = rng.randrange(len(words))
        part = words[a : a + rng.randrange(3, 60)]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(part) + 1)
            part = rng.choice([part[:at] + ["x"] + part[at:], part[:at] + part[at + 1 :]]) or ["x"]
        rows.append((100 + k, "Before, " + " ".join(part).title() + ". After all"))
    rows += [(300 + k, t[0]) for k, t in enumerate(licenses.TEMPLATES)]
    got = {(r["doc_id"], r["labels"]) for r in licenses.scan_licenses(docs(spark, rows, _row=1, _h=2, labels="x")).collect()}
    assert got == {(k, plain_spans(t or "")) for k, t in rows}
    by = dict(got)
    assert by[3] == "cc-by-nc" and by[4] == "cc-by-sa"
    assert [by[300 + k] for k in range(len(licenses.TEMPLATES))] == [t[1] for t in licenses.TEMPLATES]
    with pytest.raises(ValueError):
        licenses.template_grams(spark, templates=[("w " * licenses.MAX_WORDS, "x", "")])


# Chat


def test_windows_keep_the_budget(spark):
    rng = random.Random(3)
    count = lambda t: len(t)
    turns = [("system", "s" * 30)] + [(rng.choice(["user", "assistant"]), "".join(rng.choices("ab <|&é", k=rng.randrange(0, 90)))) for _ in range(200)] + [("assistant", "z" * 900)]
    found, seen = list(chat.windows(iter(turns), 400, 150, count)), 0
    for k, w in enumerate(found):
        marks = [(chat.unescape_role(r), chat.unescape(t)) for r, t in chat.MARK.findall(w["formatted"])]
        old = len(marks) - w["fresh"]
        assert marks[old:] == turns[seen : seen + w["fresh"]] and w["fresh"] > 0
        if k:
            assert marks[0] == turns[0] and marks[1:old] == turns[seen - old + 1 : seen]
            assert sum(count(chat.rendered(*t)) for t in marks[1:old]) <= 150
        assert len(w["formatted"]) <= 400 or w["fresh"] == 1
        shown = [chat.unescape(w["formatted"][a:z]) for a, z in w["loss"]]
        assert shown == [t for r, t in marks[old:] if r == "assistant"]
        seen += w["fresh"]
    assert seen == len(turns) and any(len(chat.MARK.findall(w["formatted"])) - w["fresh"] > 1 for w in found[1:])
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1))
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in chat.read_windows(chat.format_windows(df)).collect()) == [(0, 1), (1, 2)]
    assert chat.read_windows(chat.format_windows(df.limit(0))).count() == 0


def test_query_counts_by_the_public_vocabulary():
    count = chat.bpe_tokens("byte_bpe_multi_50k.tiktoken")()
    assert count("") == 0 and 1 <= count("hello world") <= 4


# Near duplicates


def components_of(sets):
    """The least index that each set reaches over links at 80 percent."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("n", [300, 900])
def test_groups_around_the_threshold(spark, n):
    rng = random.Random(n)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(w if rng.random() > 0.047 else f"x{rng.randrange(10**6)}" for w in base) for _ in range(n)]
    rows = list(enumerate(texts))
    sets = [set(zip(w, w[1:])) for _, t in rows for w in [t.split()]]
    want = components_of(sets)
    assert 1 < len(set(want)) < n
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows, cid=1, n=2), 2, 80).collect()}
    assert [got[k] for k in range(n)] == want


def test_recall_at_the_threshold(spark):
    """Pairs at 0.80 to 0.82 of 45 shingles in all, among others that share their words."""
    rng, rows, pairs = random.Random(1), [], 400
    for k in range(pairs):
        words = [f"v{rng.randrange(3000)}" for _ in range(46)]
        other = words[:5] + [f"q{k}"] + words[6:40] + [f"r{k}"] + words[41:]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), 2, 80).collect()}
    sets = {k: set(zip(t.split(), t.split()[1:])) for k, t in rows}
    linked = [k for k in range(pairs) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 80 * len(sets[2 * k] | sets[2 * k + 1])]
    assert len(linked) > 0.9 * pairs and all(got[2 * k] == got[2 * k + 1] for k in linked)


def test_large_nodes_stream_in_pieces(monkeypatch):
    """A dense node above HOLD is one part and proposes pairs linear in its rows; one of unlike rows goes on."""
    monkeypatch.setattr(neardup, "SMALL", 32)
    monkeypatch.setattr(neardup, "HOLD", 256)
    rng = np.random.default_rng(0)

    def rows(n, share):
        tokens = np.where(rng.random((n, 64)) < share, rng.integers(0, 1 << 30, 64), rng.integers(0, 1 << 30, (n, 64))).astype("u4")
        return np.column_stack([np.full(n, 7), np.arange(n) + 1, np.full(n, 50), neardup.bits_of(tokens).view("i8")]).astype("i8")

    for n, share in ((1000, 0.95), (200, 0.95), (1000, 0.2), (200, 0.2)):
        stream = neardup.NodeStream(0.8)
        data = rows(n, share)
        for at in range(0, n, 90):
            stream.add(data[at : at + 90])
        stream.close()
        out = stream.taken()
        kinds = out["kind"].value_counts().to_dict()
        if share > 0.9:
            assert set(out.loc[out["kind"] == neardup.PART, "a"]) == set(range(1, n + 1)) and kinds[neardup.PAIR] <= n
            assert out.loc[out["kind"] == neardup.PART, "b"].nunique() == 1
        else:
            assert kinds == {neardup.ONWARD: n}


# Decontamination


def test_recall_of_planted_edits(spark):
    rng, items, rows = random.Random(2), [], []
    for k in range(60):
        items.append((k, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.randrange(14, 60)))))
        for j in range(4):
            words = items[-1][1].split()
            edits = contamination.limit(len(words)) if j else 0
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"e{rng.randrange(999)}"] * (rng.random() < 0.7)
            rows.append((10 * k + j, " ".join(["before"] * rng.randrange(90) + words + ["after"] * rng.randrange(90))))
    rows += [(10_000 + k, " ".join(f"t{rng.randrange(400)}" for _ in range(300))) for k in range(60)]
    found = contamination.find_items(docs(spark, rows, item=1), spark.createDataFrame(items, "item_id int, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    planted, want = {(10 * k + j, k) for k in range(60) for j in range(4)}, set()
    hashed = {k: contamination.hashed(t) for k, t in items}
    for d, t in rows:
        for k, item in hashed.items():
            if d // 10 == k or d >= 10_000:
                dist, *_ = contamination.edit_span(item, contamination.hashed(t))
                if dist <= contamination.limit(len(item)):
                    want.add((d, k))
    assert got <= want and len(want & planted) > 200
    assert len(got & want) >= 0.98 * len(want)


# Models


def test_label_model_equals_plain_em(spark):
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.2
    rate = np.array([[0.5, 0.02], [0.4, 0.01], [0.4, 0.01], [0.1, 0.1]])
    x = (rng.random((600, 4)) < np.where(truth[:, None], rate[:, 0], rate[:, 1])).astype(float)
    x[:, 2] = x[:, 1]  # says the same twice
    a, b, prior = np.array([0.4, 0.3, 0.3, 0.1]), np.array([0.05, 0.05, 0.05, 0.1]), 0.2
    votes = spark.createDataFrame([([int(k) for k in np.flatnonzero(r)],) for r in x], "_v array<int>")
    weights, bias = toxicity.label_model(votes, 3, a.copy(), b.copy(), prior)
    share = np.ones(4)
    for _ in range(toxicity.ROUNDS):
        w = np.vstack([np.log(a / b), np.log((1 - a) / (1 - b))]) / share
        p = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + x @ w[0] + (1 - x) @ w[1])))
        yes = p.sum()
        a = np.clip((p @ x + 0.5) / (yes + 5), 1e-3, 0.95)
        b = np.clip(((1 - p) @ x + 0.05) / (600 - yes + 5), 1e-5, 0.95)
        a[:3] = np.maximum(a, 2 * b)[:3].clip(max=0.95)
        share = np.ones(4)
        for i in range(4):
            for j in range(4):
                c = ((p * x[:, i] * x[:, j]).sum() / yes - a[i] * a[j]) / math.sqrt(a[i] * (1 - a[i]) * a[j] * (1 - a[j]))
                share[i] += c if i != j and c > 0.3 else 0
        prior = min(0.5, max(0.005, yes / 600))
    assert np.allclose(weights, np.vstack([np.log(a / b), np.log((1 - a) / (1 - b))]) / share)
    assert bias == pytest.approx(math.log(prior / (1 - prior))) and share[1] > 1.9 and share[0] < 1.2


@pytest.fixture(scope="module")
def larger(spark):
    return {n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels")}


def test_toxicity_of_held_out_documents(spark, larger):
    got = toxicity.score_toxicity(larger["documents"], larger["labels"]).where("held_out").join(larger["labels"], "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.88 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_patterns_vote_without_a_lexicon():
    voters = lambda t: toxicity.votes_of(t, ("idiot$",))[0]
    assert voters("") == [] and voters("an idiot here") == [0] and voters("idiot, idiot!") == [0, 1]
    assert voters("stop this now!! and here!! too") == [2] and voters("THIS IS SHOUTED AT EVERYONE HERE, and more") == [3] and voters("sooooo bad") == [4]


def test_quality_of_held_out_documents(spark, larger):
    """Labels of two thirds of the documents judge the others."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.score_quality(larger["documents"], larger["labels"].where(~third)).join(larger["labels"].where(third), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.02 * n[0, False]


def test_posteriors_equal_plain_shrinkage(spark):
    rng = random.Random(9)
    rows = [(k, rng.random() ** (1 + k % 3), f"h{int(rng.expovariate(0.3))}" if k % 11 else None, rng.choice(["x", "y", None])) for k in range(500)] + [(900, 0.3, "alone", "x")]
    df = spark.createDataFrame(rows, "_k bigint, p double, host string, path string").withColumn("_site", F.lit(3))
    got = {r["_k"]: r for r in quality.posteriors(df.drop("_site"), "p", "host", "path").collect()}
    prior = sum(r[1] for r in rows) / len(rows)
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for _, p, h, s in rows:
        hosts[h].append(p)
        paths[h, s].append(p)

    def strength(groups, around):
        chance = [around[g] * (1 - around[g]) for g in groups]
        between = sum((sum(v) / len(v) - around[g]) ** 2 - c / len(v) for (g, v), c in zip(groups.items(), chance))
        return min(1e4, max(1.0, sum(chance) / max(between, 1e-9)))

    hk = strength(hosts, {h: prior for h in hosts})
    around = {h: (hk * prior + sum(v)) / (hk + len(v)) for h, v in hosts.items()}
    pk = strength(paths, {g: around[g[0]] for g in paths})
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for k, p, h, s in rows:
        host = (hk * prior + sum(hosts[h]) - p) / (hk + len(hosts[h]) - 1)
        path = (pk * host + sum(paths[h, s]) - p) / (pk + len(paths[h, s]) - 1)
        assert got[k]["host_posterior"] == pytest.approx(host) and got[k]["path_posterior"] == pytest.approx(path)
        assert got[k]["posterior"] == pytest.approx(1 / (1 + math.exp(-(logit(p) + quality.SITE_WEIGHT * (logit(path) - logit(prior))))))
    assert got[900]["path_posterior"] == pytest.approx(prior)


def test_operators_take_clashing_columns_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, EDGE, _k=1, _v=2, _site=3, p=4, score=5, kept=6)
    assert quality.score_quality(df, labels).count() == toxicity.score_toxicity(df, labels).count() == len(EDGE)
    empty = df.limit(0)
    assert quality.score_quality(empty, labels).count() == toxicity.score_toxicity(empty, labels).count() == 0
    assert neardup.near_duplicates(empty).count() == licenses.scan_licenses(empty).count() == gif.store_texts(empty).count() == 0


def test_urls_of_any_length_and_ties(spark):
    long = "http://x.net/" + "a1/" * 20_000
    rows = [(1, long), (1, long), (2, "http://a.org/" + "good" * 9), (3, "http://b.com/de/" + "bad" * 9), (4, None), (4, None), (5, "http://y.net/?q#f")]
    df = spark.createDataFrame(rows, "page_id int, url string").withColumns({"_u": F.lit(1), "score": F.lit(2), "host": F.lit("h"), "_x": F.lit(3)})
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows) and len({(r["page_id"], r["path"], r["score"], r["verdict"]) for r in got}) == 5
    by = {r["page_id"]: r for r in got}
    assert by[1]["path"] == long[12:] and by[5]["path"] == "/" and by[4]["host"] == by[4]["path"] == "" and by[2]["verdict"] == "allow" and by[3]["verdict"] == "block"


def test_bpe_returns_many_rows_in_order(spark):
    rows = [(k, None if k % 7 == 0 else f"row {k} " * (k % 5)) for k in range(1000)]
    path = bpe.public_path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), path, P.PATTERN).collect()
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path()), special_tokens={})
    assert [(r["doc_id"], r["ids"]) for r in got] == [(k, want.encode_ordinary(t or "")) for k, t in rows]
