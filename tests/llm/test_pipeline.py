import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq

from gridspark.llm.queries import tokenizer

from . import brute


def fill(budget, children):
    """children: {name: (capacity, weight)} -> shares, by raising the level until the budget is gone."""
    full, share = set(), {}
    while True:
        left = budget - sum(children[k][0] for k in full)
        weight = sum(w for k, (_, w) in children.items() if k not in full)
        share = {k: c if k in full else (left * w / weight if weight else 0) for k, (c, w) in children.items()}
        over = [k for k in children if k not in full and share[k] >= children[k][0]]
        if not over or not weight:
            return share
        full.update([min(over, key=lambda k: children[k][0] / children[k][1])])


def mixed(docs, epochs_max):
    """docs: [(id, text, lang, source)] -> [(id, text)] as often as taken; domains 4:3:2:1."""
    size, members = {}, {}
    for i, t, lang, s in docs:
        domain = "domain" + str(("0123456789abcdef".index(hashlib.md5(s.encode()).hexdigest()[0]) + 1) % 4)
        leaf = (domain, lang, s)
        n = len(brute.words(t))
        size[leaf] = size.get(leaf, 0) + n
        members.setdefault(leaf, []).append((i, t, n))
    cap = lambda prefix: sum(epochs_max * n for leaf, n in size.items() if leaf[: len(prefix)] == prefix)
    weight = lambda prefix: {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}[prefix[0]] if len(prefix) == 1 else 1
    budget = {(): float(sum(size.values()))}
    for depth in (1, 2, 3):
        for parent in [p for p in budget if len(p) == depth - 1]:
            kids = {leaf[:depth] for leaf in size if leaf[: depth - 1] == parent}
            budget |= fill(budget[parent], {k: (float(cap(k)), weight(k)) for k in kids})
    out = []
    for leaf, own in members.items():
        total, given = size[leaf], int(budget[leaf] + 1e-9)
        epochs = given // total if total else 0
        left, before = given - epochs * total, 0
        for _, i, t, n in sorted((hashlib.md5(f"0:{epochs}:{i}".encode()).hexdigest(), i, t, n) for i, t, n in own):
            out += [(i, t)] * (epochs + (before < left))
            before += n
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    bodies = [text(rng.randrange(30, 120)) for _ in range(120)]
    bodies += [b + "\n" for b in bodies[:15]] + [b + " tail" for b in bodies[10:30]] + ["junk " * 80, "", None, "A | B | " * 40]
    data = [(i, t, rng.choice(["en", "de"]), f"src{rng.randrange(6)}", 0) for i, t in enumerate(bodies)]
    cols = [list(c) for c in zip(*data, strict=True)]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names), tmp_path / "documents.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    kept, left = {}, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, str(tmp_path)).cache()
        assert left.columns == names
        kept[name] = sorted(r["doc_id"] for r in left.collect())
    by = {r[0]: r for r in data}
    assert kept["quality_rules"] and not set(range(155, 159)) & set(kept["quality_rules"])
    assert all(not (brute.rules(by[i][1])[0] < 50) for i in kept["quality_rules"])
    exact = sorted({k for _, k, *_ in brute.exact([(i, by[i][1]) for i in kept["quality_rules"]])})
    assert kept["exact_dedup"] == exact
    near = brute.components([(i, by[i][1]) for i in exact], 5, 80)
    assert kept["near_dedup"] == sorted(i for i, (_, c) in near.items() if c == i)

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for i, t in mixed([by[i][:4] for i in kept["near_dedup"]], 2):
        e = tok.encode(t, add_special_tokens=False)
        want.append((i, len(e.ids), brute.sha(" ".join(map(str, e.ids))), brute.sha(tok.decode(e.ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_takes_null_sources(spark):
    import corpus_pipeline

    names = "doc_id bigint, text string, lang string, source string"
    alone = [(i, "w " * (i + 1), "en", None) for i in range(20)]
    got = corpus_pipeline.mix(spark, spark.createDataFrame(alone, names), "")
    assert sorted(map(tuple, got.collect())) == alone

    rng = random.Random(15)
    data = [(i, "w " * rng.randrange(1, 40), rng.choice(["en", "de"]), rng.choice([None, *(f"src{k}" for k in range(6))])) for i in range(200)]
    got = sorted(tuple(r)[:2] for r in corpus_pipeline.mix(spark, spark.createDataFrame(data, names), "").collect())
    assert got == sorted(mixed([(i, t, lang, s or "") for i, t, lang, s in data], 2))
    assert {i for i, _ in got} & {i for i, _, _, s in data if s is None}


def test_stages_of_odd_tables(spark, odd, tmp_path):
    """Null and repeated ids, clashing columns and an empty table, stage by stage; all stages but the last return the columns they got."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    table = odd.withColumns({"text": F.when(F.col("text") != "", F.concat_ws(" ", "text", F.lit(" ".join(f"word{i}" for i in range(60)))))} | {c: F.lit("x") for c in ("domain", "copies")})
    for start, least in ((table, 3), (table.where("false"), 0)):
        left = start
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, left, str(tmp_path))
            if name != "bpe":
                assert got.columns == start.columns, name
            left = got.cache()
        assert least <= left.count() <= 9 and left.columns[0] == "doc_id"
