import collections
import hashlib
import math
import random
import re

import corpus_pipeline
from tilewright.llm import decontaminate, jaccard_join, mixing, secret_scan, toxicity
from tilewright.llm.subword import word_bytes

from .conftest import SCHEMA, words
from .test_text_operators import WS, brute_hits, brute_secrets, lower, naive_logits


def test_pipeline_against_plain_python(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(words(r, 40, 5000)), "en", f"s{i % 4}", 1) for i in range(80)]
    rows[10] = (10, rows[3][1], "en", "s2", 1)
    rows[11] = (11, rows[3][1] + " more", "en", "s3", 1)
    rows[20] = (20, rows[20][1] + " zonk zonk", "en", "s0", 1)
    rows[21] = (21, rows[21][1] + " secret: abcdef0123456789abcdef99", "en", "s1", 1)
    rows[22] = (22, rows[22][1] + " " + " ".join(f"bench{i}" for i in range(12)), "en", "s2", 1)
    rows += [(100 + i, " ".join(words(r, 30, 5000)) + (" zonk" if i % 2 else ""), "en", "train", 1) for i in range(200)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), [c.split()[0] for c in SCHEMA.split(", ")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
    kept = {x.doc_id: x for x in docs.collect()}
    toxic = {x[0] for x in rows if "zonk" in x[1]}
    assert not toxic & set(kept) and not {10, 11, 22} & set(kept)
    assert set(range(80)) - {10, 11, 20, 22} <= set(kept)
    assert "[SECRET]" in kept[21].text and kept[21].n_chars == len(kept[21].text)
    out = corpus_pipeline.run(spark, d).collect()
    sizes = sum(len(x.text.split()) for x in kept.values())
    assert abs(sum(x.mix_words for x in out) - 1.5 * sizes) <= 5 and {x.doc_id for x in out} <= set(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    assert all((decontaminate, jaccard_join, mixing, secret_scan))


def mixed(rows):
    """The mix of (doc_id, text, lang, source, n_chars) rows by its rules, without equal doc_ids: (doc_id, copy, words, position, text)."""
    size = {r[0]: len(WS.findall(r[1] or "")) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size[r[0]]
    ranked = sorted(total, key=lambda s: (s is None, s or ""))
    weight, tilt = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(ranked)}, {s: mixing.TILTS[i % 3] for i, s in enumerate(ranked)}
    full = set()
    while True:
        open_ = sum(w for s, w in weight.items() if s not in full)
        level = (mixing.SHARE * sum(total.values()) - sum(2 * total[s] for s in full)) / open_ if open_ else 0.0
        more = {s for s in ranked if s not in full and weight[s] * level > 2 * total[s]}
        if not more:
            break
        full |= more
    out = []
    for s in ranked:
        words, before = math.floor((2.0 * total[s] if s in full else weight[s] * level) + 0.5), 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            for copy in range(2):
                n = max(0, min(size[r[0]], words - copy * total[s] - before))
                if n:
                    u, c = (copy * total[s] + before + n / 2) / words, tilt[s]
                    at = 2 * u / ((1 - c) + math.sqrt((1 - c) ** 2 + 4 * c * u))
                    text = r[1] if n == size[r[0]] else "".join(re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r[1])[:n])
                    out.append((r[0], copy, n, round(at, 9), text))
            before += size[r[0]]
    return out


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    """Every row of the mix, from toxicity scores by the naive model to cut texts."""
    r = random.Random(14)
    bench = " ".join(f"bench{i}" for i in range(14))
    rows = []
    for i in range(160):
        t = words(r, r.choice([2, 4, 30, 60, 90]), 3000)
        if i % 5 == 1:
            t = rows[-1][1].split(" ")
            for _ in range(r.randint(0, 1)):
                t[r.randrange(len(t))] = f"edit{r.randrange(99)}"
        s = " ".join(t)
        if i % 11 == 3:
            s += " zonk zonk"
        if i % 13 == 4:
            s += " " + bench
        if i % 7 == 2:
            s += f" token: {r.randrange(10**9)}abc and AKIA{'A1B2' * 5} k9Xz7Qp2Lm4Rt8Vw1Yb3N{i}c6"
        rows.append((i, s, "en", None if i % 17 == 0 else f"s{i % 4}", len(s)))
    rows += [(1000 + i, " ".join(words(r, 20, 3000)) + (" zonk" if i % 2 else ""), "en", "train", 1) for i in range(120)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, " \n ", "en", "s1", 3)]
    d, schema = str(tmp_path), SCHEMA
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(1000 + i, 1, i % 2) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(1, bench), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))

    def toxic(t):
        if not word_bytes(t):
            return False
        z = naive_logits(model, t)
        return 1 / (1 + math.exp(min(50, max(-50, z[0] - z[1])))) >= 0.5

    kept = [x for x in rows if not toxic(x[1])]
    assert 15 < len(rows) - len(kept) < 140
    sets = {}
    for x in kept:
        w = WS.findall(lower(x[1]))
        sets[x[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    single = [x for x in kept if find(x[0]) == x[0]]
    clean = [x for x in single if not brute_hits(x[1], items)[1]]
    assert len(kept) - len(single) > 10 and len(single) - len(clean) > 5
    masked = []
    for x in clean:
        out, at = "", 0
        spans = sorted(sum(brute_secrets(x[1]), []))
        for a, _, b in spans:
            if a >= at:
                out += x[1][at:a] + secret_scan.MARK
            at = max(at, b)
        text = out + x[1][at:] if spans else x[1]
        masked.append((x[0], text, x[2], x[3], len(text) if spans else x[4]))
    assert sum(a[1] != b[1] for a, b in zip(masked, clean)) > 10
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((x.doc_id, x.mix_copy, x.mix_words, round(x.mix_position, 9), x.text) for x in got) == sorted(mixed(masked))
    assert [x.mix_position for x in got] == sorted(x.mix_position for x in got)
    own = {x[0]: x for x in masked}
    assert all((x.lang, x.source, x.n_chars) == own[x.doc_id][2:] for x in got)


def test_pipeline_odd_rows_and_reruns(spark, odd_rows, tmp_path):
    """Nulls, ties, repeated rows and ids: the same mix whatever order rows come in. Empty tables: empty."""
    r = random.Random(3)
    rows = [*odd_rows, *((i % 9, " ".join(words(r, 12, 60)), "en", "s", i) for i in range(60)), *((70, f"tie {i % 3} of three words", "en", "a", 1) for i in range(12))]
    mixes = []
    for k in range(2):
        d = str(tmp_path / str(k))
        r.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(2 + 3 * k).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "nothing like this"), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        mixes.append(sorted(map(str, corpus_pipeline.run(spark, d).collect())))
    assert mixes[0] == mixes[1] and len(mixes[0]) > 20
    d = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_drops_edited_near_copies(spark):
    r = random.Random(5)
    rows = [(i, " ".join(words(r, 100, 5000)), "en", "s0", 1) for i in range(30)]
    for i, edits in enumerate([(30, 70), (10, 50, 90)]):  # of five words 0.811 and 0.730, of three 0.885 and 0.832
        w = rows[i][1].split(" ")
        for at in edits:
            w[at] = f"edit{at}"
        rows.append((100 + i, " ".join(w), "en", "s0", 1))
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {*range(30), 101}
