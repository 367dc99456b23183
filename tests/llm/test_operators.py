import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import bpe, common, exact_dedup, langid, license_scan, minhash, mixing, quality_model, quality_rules, secret_scan, wavelet
from gridspark.llm.components import components
from gridspark.llm.queries import tokenizer

from . import brute


def rows(df, *cols):
    got = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, text string")


# BPE


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def test_bpe_matches_the_library(docs, texts):
    tok = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, tokenizer("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        e = tok.encode(t or "", add_special_tokens=False)
        assert got[i]["ids_text"] == " ".join(map(str, e.ids)), t
        assert got[i]["decoded"] == tok.decode(e.ids, skip_special_tokens=False) and got[i]["n_tokens"] == len(e.ids)
    one = {r["doc_id"]: r for r in bpe.digest(docs, tokenizer("word_bpe_49k.json")).collect()}
    assert one[3]["ids_sha256"] == brute.sha(got[3]["ids_text"]) and one[0]["decoded_sha256"] == brute.sha("")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_round_trip(spark, docs, empty, texts, name):
    tok = library(name)
    ids = bpe.encode(docs, tokenizer(name))
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    for i, t in enumerate(texts):
        assert got[i] == tok.encode(t or "", add_special_tokens=False).ids, t
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(ids, tokenizer(name)).collect()}
    assert all(back[i] == tok.decode(got[i], skip_special_tokens=False) for i in got)
    assert bpe.encode(empty, tokenizer(name)).count() == 0
    twice = some(spark, [(None, "a"), (1, "a"), (1, "a")])
    assert bpe.digest(twice, tokenizer("word_bpe_49k.json")).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_of_concatenations_is_exact(name):
    rng, tok = random.Random(3), library(name)
    with open(tokenizer(name), encoding="utf-8") as f:
        spec = json.load(f)
    trees = [bpe.TreeEncoder(spec), bpe.TreeEncoder(spec, threads=2)]
    for alphabet in ("ab", "aab", "abcdefghij", "thereinganaton", "éüa"):
        for n in (1, 63, 64, 65, 700, 5000):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            seen = "".join(bpe.byte_alphabet()[b] for b in word.encode())
            for tree in trees:
                assert [i for i, _ in tree.encode(seen, leaf=64)] == tok.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_tokens_part_long_pieces(name):
    rng, tok = random.Random(21), library(name)
    known = bpe.facts(tokenizer(name))
    table = bpe.Pieces(known)
    body = lambda n: "".join(rng.choice("abcABéÉ") for _ in range(n))
    for special in known.special:
        for made in (body(3000) + special + body(5000), special + body(4000) + special + special, body(3000) + special[:-1] + body(3000) + special + "Z"):
            assert table.long(made) == tok.encode(made, add_special_tokens=False).ids


def test_piece_tables_are_bounded():
    import pyarrow as pa

    tok, table = library("word_bpe_49k.json"), bpe.Pieces(bpe.facts(tokenizer("word_bpe_49k.json")), most=3000)
    texts = [f"word{i} other{i} word{i % 3}" for i in range(200)]
    ids, sizes = bpe.ids_of_batch(table, pa.array(texts, pa.string()))
    assert 0 <= table.room < 3000 and 0 < sum(len(k) + len(v) + bpe.ENTRY for k, v in table.items()) <= 3000
    assert ids.tolist() == [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids] and len(sizes) == 200


def test_pieces_of_random_text():
    rng = random.Random(5)
    marks = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'", "'s", ".", "1", "́", "×", "\xa0", "\x1f", "—", "日", "%", "<|endoftext|>"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        import pyarrow as pa

        table, tok = bpe.Pieces(bpe.facts(tokenizer(name))), library(name)
        texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(3000)]
        ids, sizes = bpe.ids_of_batch(table, pa.array(texts, pa.string()))
        at = 0
        for t, n in zip(texts, sizes, strict=True):
            assert ids[at : at + n].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
            at += n


# Quality model


def test_quality_model(spark):
    rng = random.Random(1)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(40, 200))) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "now!!", "$$$", "|", "click"]) for _ in range(rng.randrange(40, 200)))
    pairs = [(i, good() if i % 3 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(3, None)], "doc_id bigint, quality int")
    got = quality_model.classify(some(spark, [*pairs, (1000, None), (1001, ""), (None, "x")]), labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(got) == 603 and len(held) > 80
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = quality_model.classify(some(spark, pairs[:3]), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_model.classify(some(spark, []), labels).count() == 0


def test_quality_against_one_matrix(spark):
    rng = random.Random(25)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    made = []
    for i in range(400):
        text = " ".join(rng.choice(["BUY", "now!!", "$$$", "|", "é", "x1"]) if rng.random() < i % 5 / 5 else word() for _ in range(rng.randrange(1, 60)))
        made.append((i, text.replace(" x1", "\n")))
    made += [(1000, None), (1001, ""), (1002, " \n"), (1003, "word " * 30_000)]
    labels = [(i, int(rng.random() > i % 5 / 5)) for i in range(300)] + [(5, 1), (6, None), (5000, 1)]
    want = brute.quality(made, labels)
    got = quality_model.classify(some(spark, made).repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert max(abs(r["score"] - want[r["doc_id"]]) for r in got) < 1e-5
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: brute.crc32(i) % 5 == 0 for i, _ in made}


def test_isotonic():
    got = quality_model.isotonic(np.arange(5), np.array([0.0, 0.6, 0.2, 0.4, 1.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0]))
    assert np.allclose(got, [0, 0.4, 0.4, 0.4, 1.0])
    assert len(quality_model.isotonic(np.zeros(0), np.zeros(0), np.zeros(0))) == 0


# Near-duplicates


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, texts, size, percent):
    rng = random.Random(2)
    made = list(texts)
    for edits in (1, 2, 3, 4, 6, 9):
        made += family(rng, 40, 120, edits)
    made += made[30:60]
    rng.shuffle(made)
    pairs = list(enumerate(made))
    want = sorted((i, n, c if n else i, (c if n else i) == i) for i, (n, c) in brute.components(pairs, size, percent).items())
    got = minhash.near_duplicates(some(spark, pairs), size, percent)
    assert rows(got) == sorted(want, key=repr)
    kept = minhash.keep_one(some(spark, pairs), size, percent)
    assert rows(kept, "doc_id") == sorted(((i,) for i, _, _, k in want if k), key=repr) and kept.columns == ["doc_id", "text"]


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(some(spark, [])).count() == 0
    got = rows(minhash.near_duplicates(some(spark, [(None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "a b c d"), (3, None)])))
    assert got == sorted([(None, 2, None, True), (2, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (3, 0, 3, True)], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (7, 7), (103, 100), (200, None)]
    got = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Secrets


def test_secrets_against_brute_force(docs, texts, empty):
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.secrets(docs)).collect()}
    for i, t in enumerate(texts):
        want = brute.secrets(t)
        assert got[i]["base_sha256"] == brute.sha(want), t
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert secret_scan.secrets(empty).count() == 0


def test_many_secrets_in_one_text(spark):
    text = "é password=p token = abcdefgh\n" * 700
    got = secret_scan.digest(secret_scan.secrets(some(spark, [(1, text)]))).first()
    assert got["base_sha256"] == brute.sha(brute.secrets(text)) and got["n_assign"] == 700


def test_randomness_battery(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (24, 32, 40, 64) for _ in range(20)]
    plain = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalizationframework", "getCustomerAccountManagerName", "abababababababababababababab", "0000000000000000000000000000", "----------------------------"]
    pairs = [(i, f"x {k} y") for i, k in enumerate(keys + plain)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.secrets(some(spark, pairs)).collect()}
    assert sum("random" in got[i] for i in range(len(keys))) >= 0.85 * len(keys)
    assert not any("random" in got[i] for i in range(len(keys), len(pairs)))


def test_every_run_is_tested(spark):
    rng = random.Random(14)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda alphabet, n=40: "".join(rng.choice(alphabet) for _ in range(n))
    made = []
    for _ in range(12):
        made += [(f"{name}{k}{end}", len(name), k) for name, end in (("AWS_SECRET_ACCESS_KEY=", " x"), ("?sig=", "&b"), ("auth=", "")) for k in [key(base62 + "+/")]]
        made += [("auth=" + (k := key(base62 + "_-") + "="), 5, k), ("/srv/my-app/" + (k := key(base62)) + "/a_b", 12, k)]
        # No part of this reaches 20 characters of one alphabet.
        made += [("é " + (k := "+".join(key(base62, 9) + "-" + key(base62, 8) for _ in range(4))), 2, k)]
    pairs = [(i, t) for i, (t, _, _) in enumerate(made)]
    scanned = secret_scan.scan(some(spark, pairs)).collect()
    measured = {r["doc_id"]: {(s["start"], s["stop"]): s["test"] for s in r["runs"]} for r in scanned}
    found = {r["doc_id"]: {(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "random"} for r in secret_scan.secrets(some(spark, pairs)).collect()}
    for i, (t, at, k) in enumerate(made):
        assert measured[i][at, at + len(k)]["n"] == len(k.rstrip("=")), t
    for kind in range(6):
        assert sum((at, at + len(k)) in found[i] for i, (_, at, k) in enumerate(made) if i % 6 == kind) >= 10, made[kind]


def test_random_spans_against_brute_force(spark, texts):
    rng = random.Random(22)
    base62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    key = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    made = list(texts)
    for _ in range(150):
        n = rng.choice([20, 24, 32, 40, 64, 90, 200])
        made.append("é x " + rng.choice([key(base62, n), key(base62 + "+/", n) + "==", key("0123456789abcdef", n), key("0123456789", n), key("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n)]) + " y")
        made.append(rng.choice(["_", "-", "/", "", "+"]).join(word() for _ in range(rng.randrange(4, 14))))
        made.append("".join(word().capitalize() for _ in range(rng.randrange(4, 9))) + " " + "_".join(word().upper() for _ in range(5)))
        made.append(f"/srv/{word()}-{word()}/{key(base62, 40)}/{word()}_{word()}+{key(base62, 12)}")
    got = secret_scan.secrets(some(spark, list(enumerate(made)))).collect()
    found = sorted((r["doc_id"], s["start"], s["stop"]) for r in got for s in r["spans"] if s["kind"] == "random")
    assert found == brute.random_spans(made) and len(found) > 150


def test_long_runs_are_tested_in_one_pass(spark):
    rng = random.Random(23)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    made = ["".join(rng.choices(base64, k=n)) for n in (8192, 8193, 8194, 16385, 2_000_000)] + ["".join(rng.choices(base64, k=300_000)) + "_" + "a" * 300_000]
    began = time.perf_counter()
    tests = {r["doc_id"]: {(s["start"], s["stop"]): s["test"] for s in r["runs"]} for r in secret_scan.scan(some(spark, list(enumerate(made)))).collect()}
    assert time.perf_counter() - began < 120
    for i, t in enumerate(made[:5]):
        n, p, log_e = brute.battery(t)
        test = tests[i][0, len(t)]
        assert test["n"] == n and abs(test["p"] - p) < 1e-6 and abs(test["log_e"] - log_e) < 1e-6 * abs(log_e)
    assert tests[5][0, 600_001]["p"] == 0 and tests[5][0, 300_000]["p"] > 1e-6


def test_secrets_of_odd_rows(spark):
    key = "Zk3vQx9LmT2bRw8NpYc5HdJf7GsKa4Ue"
    table = some(spark, [(None, f"token={key}"), (1, f"token={key}"), (1, f"token={key}"), (2, None)]).withColumns({c: F.lit("x") for c in ("t", "base", "runs", "spans", "kind")})
    got = rows(secret_scan.digest(secret_scan.secrets(table)))
    assert [r[0] for r in got] == [1, 1, 2, None] and got[0] == got[1] and got[0][1:] == got[3][1:] and got[0][1] == 1


# Quality rules


def test_rules_against_brute_force(docs, texts, empty):
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute.rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.verdicts(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_policies_and_ablations(spark):
    table = some(spark, [(1, "word " * 60), (2, "a few words"), (3, " ".join(f"good{i} text" for i in range(60))), (4, None)])
    led = quality_rules.ledger(table)
    assert "text" not in led.columns
    two = quality_rules.Policy("two", 2, quality_rules.mask("few_words", "repeated_windows"))
    got = {r["rule"]: (r["n_docs"], r["n_failed"], r["n_only"]) for r in quality_rules.ablation(led, two).collect()}
    assert got == {"few_words": (4, 2, 2), "repeated_windows": (4, 1, 1)}
    assert rows(led.where(quality_rules.passes(two)), "doc_id") == [(3,)]
    assert quality_rules.ablation(led.where("false"), two).first()["n_failed"] == 0


# Licences


def test_licenses_against_brute_force(docs, texts, empty):
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.licenses(docs)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.licenses(empty).count() == 0


def test_license_rules(spark):
    said = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache-2", "GNU General Public License version 3": "gpl-3", "GPLv2 or later": "gpl-2",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa", "Creative Commons Attribution ShareAlike 4.0": "cc-by-sa", "Mozilla Public License 2.0": "mpl-2",
        "dedicated to the public domain": "public-domain", "All rights reserved.": "proprietary", "er kam mit der Bahn": "",
    }
    got = {r["doc_id"]: r["labels"] for r in license_scan.digest(license_scan.licenses(some(spark, list(enumerate(said))))).collect()}
    assert got == dict(enumerate(said.values()))
    assert len(license_scan.rules()) >= 200


def samples(pattern):
    """Texts that a regular expression of the rules fits: each choice of its branches, options and classes' first members."""
    from re import _constants as op
    from re import _parser as parser

    def made(items):
        out = [""]
        for kind, value in items:
            if kind is op.LITERAL:
                more = [chr(value)]
            elif kind is op.NOT_LITERAL:
                more = ["x"]
            elif kind is op.IN:
                more = [chr(value[0][1] if value[0][0] is op.LITERAL else value[0][1][0])]
            elif kind is op.SUBPATTERN:
                more = made(value[3])
            elif kind is op.BRANCH:
                more = [x for branch in value[1] for x in made(branch)]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, _, inner = value
                more = [x * n for n in sorted({low, max(low, 1)}) for x in (made(inner) if n else [""])]
            else:
                raise AssertionError(kind)
            out = [a + b for a in out for b in more]
        return out

    return made(parser.parse(pattern))


def named_texts():
    """(label, keyword, text) of what each rule fits, in its last template, which is its name alone."""
    said = [(label, key, text) for label, key, name in license_scan.named() for text in samples(name)]
    return said + [(label, key, text) for _, _, label, key, name in license_scan.SENTENCES for text in samples(name)]


def test_license_gate_passes_what_rules_fit(spark):
    said = named_texts()
    assert len(said) > 500 and not [x for x in said if not re.search(license_scan.GATE, x[2])]
    assert all(re.search(license_scan.GATE, phrase) for phrase, _ in license_scan.PHRASES)
    texts = {"Released under the BSD 3-Clause.": "bsd-3", "distributed under the New BSD terms": "bsd-3", "2-clause BSD": "bsd-2", "Released under the terms of WTFPL": "wtfpl", "ALL  RIGHTS\nreserved": "proprietary", "cc-by": "cc-by"}
    got = {r["doc_id"]: r["labels"] for r in license_scan.digest(license_scan.licenses(some(spark, list(enumerate(texts))))).collect()}
    assert got == dict(enumerate(texts.values()))


def test_license_priority_and_containment(spark):
    said = {
        "released under foo and the MIT License": "mit,unknown", "Licensed under the MIT License": "mit", "released under the terms of the Foo License": "unknown",
        "GNU Lesser General Public License version 2.1": "lgpl-2.1", "Licensed under the GNU Affero General Public License v3.0 only": "agpl-3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
        "Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
        "to the public domain. Dual: BSD-2-Clause, Apache License 1.1; http://creativecommons.org/licenses/by-nd/3.0": "apache-1.1,bsd-2,cc-by-nd,public-domain",
    }
    got = {r["doc_id"]: r["labels"] for r in license_scan.digest(license_scan.licenses(some(spark, list(enumerate(said))))).collect()}
    assert got == dict(enumerate(said.values()))
    assert len(license_scan.named()) + len(license_scan.SENTENCES) >= 250


def test_licenses_against_plain_rules(spark, texts):
    rng = random.Random(24)
    words = [text for _, _, text in named_texts()]
    before = ["licensed under the", "under the terms of", "SPDX-License-Identifier:", "subject to", "license", "released under foo and", "", "and", "published under a"]
    made = [*texts, "the MIT License " * 700, "released under x the Apache License 2.0 or GPLv2 " * 300]
    made += [" ".join(f"{rng.choice(before)} {rng.choice(words)}" for _ in range(rng.randrange(1, 9))).title() for _ in range(150)]
    got = {r["doc_id"]: sorted(tuple(m) for m in r["found"]) for r in license_scan.licenses(some(spark, list(enumerate(made)))).collect()}
    plain = [(r["prio"], r["conf"], r["label"], re.compile(r["pattern"])) for r in license_scan.rules()]
    for i, t in enumerate(made):
        assert got[i] == brute.license_matches(t, plain, license_scan.PREFIXES), t


def test_licenses_of_odd_rows(spark):
    table = some(spark, [(None, "the MIT License"), (1, "the MIT License"), (1, "the MIT License"), (2, None)]).withColumns({c: F.lit("x") for c in ("t", "line", "id", "found", "phrases", "n_words")})
    got = rows(license_scan.digest(license_scan.licenses(table)), "doc_id", "labels", "n_words")
    assert got == [(1, "mit", 3), (1, "mit", 3), (2, "", 0), (None, "mit", 3)]


def test_every_license_rule_has_a_keyword_of_its_texts(spark):
    said = named_texts()
    assert not [(label, key, text) for label, key, text in said if key not in text]
    assert all(len(key) > 1 and not re.search(r"[^a-z0-9 ]", key) for _, key, _ in said)
    for r in license_scan.rules():
        text = samples(r["pattern"].removesuffix("(?= )"))[0]  # the name alone
        assert r["key"] in text and re.search(r["pattern"], text + " "), r
    texts = {"Under the SIL Open Font License, Version 1.1": "ofl-1.1", "the Open Font Licence": "ofl", "SPDX-License-Identifier: SIL Open Font License 1.0": "ofl-1"}
    got = {r["doc_id"]: r["labels"] for r in license_scan.digest(license_scan.licenses(some(spark, list(enumerate(texts))))).collect()}
    assert got == dict(enumerate(texts.values()))


# Language


def test_languages(spark):
    rng = random.Random(6)
    stems = {"aa": ["ban", "kel", "tor", "mi"], "bb": ["ssch", "ung", "keit", "ver"], "cc": ["eau", "oi", "que", "ment"]}
    say = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    data = [(i, say(k, rng.randrange(30, 300)), k) for i, k in enumerate(rng.choice(list(stems)) for _ in range(240))]
    data += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "aa"), (1003, say("bb", 60), None), (None, say("cc", 60), "cc")]
    got = langid.identify(spark.createDataFrame(data, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["lang_pred"] == k for i, _, k in data[:240] if by[i]["held_out"]]) > 0.97
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "bb" and by[None]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.identify(spark.createDataFrame(data[:5], "doc_id bigint, text string, lang string").withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_languages_against_a_plain_loop(spark):
    rng = random.Random(26)
    stems = {"aa": ["ban", "kel", "tor", "mi"], "bb": ["ssch", "ung", "keit", "ver"], "cc": ["eau", "oi", "que", "ment"]}
    say = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    data = [(i, say(k, rng.choice([1, 20, 300, 900])), k) for i, k in enumerate(rng.choices(list(stems), [6, 3, 1], k=500))]
    data += [(i + 500, t, k) for i, t, k in data[:60]] + [(2000, None, "aa"), (2001, " 1 ", "bb"), (2002, say("bb", 9), None), (2003, say("cc", 20_000), "cc")]
    want = brute.languages(data)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(3)).collect()}
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all(abs(got[i]["score"] - s) < 1e-9 for i, (_, s) in want.items())


def test_dictionaries_of_copies_and_openings(spark):
    rng = random.Random(16)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    say = lambda letters, n: " ".join(word(letters) for _ in range(n))
    copy, single = say("abcdef", 20), [say("abcdef", 20) for _ in range(100)]
    opening = say("uvwxyz", 130)
    data = [(i, t, "aa") for i, t in enumerate([copy] * 300 + single)] + [(1000 + i, f"{opening} {say('klmnop', 600)}", "bb") for i in range(150)]
    known = langid.dictionaries(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), F.lit(True))
    aa, bb = known["aa"][0].decode(), known["bb"][0].decode()
    assert aa.count(copy) == 1 and all(aa.count(t) == 1 for t in single)
    assert len(re.findall("[k-p]", bb)) > 2 * len(re.findall("[u-z]", bb)) and len(bb) <= langid.DOCS * (langid.PIECE + 1)
    assert [known[k][1] for k in ("aa", "bb")] == [400 / 550, 150 / 550]


# Wavelet matrix


def test_wavelet_matrix():
    rng = np.random.default_rng(7)
    old = wavelet.BLOCK
    try:
        wavelet.BLOCK = 1 << 8
        for n, top in ((0, 5), (1, 1), (3000, 50000), (5000, 7)):
            ids = rng.integers(0, top, n).astype(np.uint16)
            f = wavelet.WaveletFile(wavelet.build(ids, [1, None] if n else [], np.array([n - n // 2, n // 2] if n else [], np.int64)))
            assert (f.ids() == ids).all() and f.n == n
            for i in rng.integers(0, max(n, 1), 20 if n else 0).tolist():
                assert f.access(i) == ids[i]
                token, places = int(ids[i]), np.flatnonzero(ids == ids[i])
                assert f.count(token) == len(places) and f.count(token, 5, i) == int(((places >= 5) & (places < i)).sum())
                assert [f.select(token, k) for k in (0, len(places) - 1, len(places))] == [places[0], places[-1], -1]
            assert f.count(60000) == 0 and f.select(60000, 0) == -1
            if n:
                assert f.doc_ids == [1, None]
    finally:
        wavelet.BLOCK = old


def test_shards_round_trip(spark, docs, texts, empty):
    tok, path = library("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.json")
    got = rows(wavelet.round_trip(docs, path, 2, shards=3))
    at, want = 0, []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == sorted(want, key=repr)
    assert wavelet.round_trip(empty, path, 2).count() == 0
    odd = wavelet.round_trip(some(spark, [(5, "b"), (None, "a"), (5, "b")]), path, 2)
    assert [r["n_tokens"] for r in odd.orderBy("start").collect()] == [2, 2, 2] and odd.orderBy("start").first()["doc_id"] is None


# Mixing


def mixed(spark, data, **more):
    table = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    return table, mixing.Mix(table, ["lang", "source"], **more)


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "lang string, source string, __tokens bigint")
    got = {(r["lang"], r["source"]): r["__budget"] for r in mixing.budgets(leaves, ["lang", "source"], 400, max_epochs=2).collect()}
    assert got == {("a", "x"): 20, ("a", "y"): 180, ("b", "z"): 200}
    tight = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "z", 1000)], "lang string, source string, __tokens bigint")
    got = {(r["lang"], r["source"]): r["__budget"] for r in mixing.budgets(tight, ["lang", "source"], 400, max_epochs=2).collect()}
    assert got == {("a", "x"): 20, ("a", "y"): 40, ("b", "z"): 340}
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "lang string, weight double")
    got = {(r["lang"], r["source"]): r["__budget"] for r in mixing.budgets(leaves, ["lang", "source"], 400, {"lang": weights}, 2).collect()}
    assert got == {("a", "x"): 20, ("a", "y"): 280, ("b", "z"): 100}


def test_mix_against_brute_force(spark):
    import hashlib

    rng = random.Random(8)
    data = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", None]), "hot" if rng.random() < 0.6 else rng.choice(["s", "t"])) for i in range(400)]
    table, mix = mixed(spark, data, budget_ratio=0.9, max_epochs=3, seed=5)
    got = {r["doc_id"]: r for r in mix.documents().collect()}
    budgets = {(r["lang"], r["source"]): (r["__tokens"], r["__budget"]) for r in mix.bounds.collect()}
    want = {}
    for leaf, (total, budget) in budgets.items():
        own = [(i, len(t.split())) for i, t, lang, s in data if (lang, s) == leaf]
        assert sum(n for _, n in own) == total
        epochs = budget // total if total else 0
        left, before = budget - epochs * total, 0
        for _, i, n in sorted((hashlib.md5(f"5:{epochs}:{i}".encode()).hexdigest(), i, n) for i, n in own):
            want[i] = epochs + (before < left)
            before += n
    assert {i: r["copies"] for i, r in got.items()} == {i: c for i, c in want.items() if c}
    taken = mix.take(table)
    assert taken.columns == table.columns and taken.count() == sum(want.values())


def test_mix_of_odd_tables(spark):
    _, mix = mixed(spark, [], budget_ratio=1.0)
    assert mix.documents().count() == 0
    table, mix = mixed(spark, [(None, "a b", None, None), (1, None, "x", "y"), (2, "c d", "x", "y"), (2, "c d", "x", "y")], budget_ratio=1.0, max_epochs=1)
    assert sum(r["copies"] * r["n_tokens"] for r in mix.documents().collect()) >= 6
    _, mix = mixed(spark, [(1, "a b", "x", "y")], budget=0)
    assert mix.documents().count() == 0


# Exact dedup


def test_exact_dedup_against_brute_force(spark, docs, texts, empty):
    pairs = [*enumerate(texts), *[(100 + i, f" {t or ''}\n") for i, t in enumerate(texts)], *[(300 + i, "the same text") for i in range(50)]]
    assert rows(exact_dedup.dedup(some(spark, pairs))) == sorted(brute.exact(pairs), key=repr)
    kept = exact_dedup.keep_one(some(spark, pairs))
    assert rows(kept, "doc_id") == sorted({(k,) for _, k, *_ in brute.exact(pairs)}, key=repr)
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.keep_one(docs).columns == docs.columns


def test_exact_dedup_of_odd_rows(spark):
    got = rows(exact_dedup.dedup(some(spark, [(None, "a b"), (7, "ab"), (7, "ab"), (None, None)])))
    assert [r[:4] for r in got] == [(7, None, 3, False), (7, None, 3, False), (None, None, 1, True), (None, None, 3, True)]
    assert exact_dedup.keep_one(some(spark, [(7, "ab"), (7, "ab"), (7, "a b")])).collect() == [(7, "a b")]


def test_keep_one_of_clashing_columns_and_ties(spark):
    names = ["sha", "row", "text_sha256", "keep_id", "keep_points", "group_size", "__sha", "len", "hash", "body", "n", "id"]
    made = [(1, "a b", "q"), (1, " ab", "p"), (1, "ab ", "p"), (1, "ab ", "o"), (2, "ab", "n"), (3, None, "m"), (None, "z", "k"), (None, "z", "j")]
    want = None
    for seed in range(4):
        data = list(made)
        random.Random(seed).shuffle(data)
        table = spark.createDataFrame(data, "doc_id bigint, text string, sha string").repartition(3)
        table = table.withColumns({n: F.col("sha") for n in names[1:]} | {"a b": F.lit(1), "m": F.create_map(F.lit(1), F.lit(2))})
        got = exact_dedup.keep_one(table)
        assert got.columns == table.columns
        got = sorted((tuple(r)[:4] for r in got.collect()), key=repr)
        want = want or got
        assert got == want
    texts = [" ab", "a b", "ab "]
    first = min(texts, key=brute.md5)
    assert want[0][:2] == (1, first) and want[0][2] == min(c for i, t, c in made if t == first) and want[1:] == [(3, None, "m", "m"), (None, "z", "j", "j")]


def test_patricia_trie():
    rng = random.Random(9)
    trie, want = exact_dedup.Patricia(), {}
    for _ in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        points, ident = rng.randrange(3), rng.choice([None, *range(50)])
        trie.insert(key, points, ident, 1, key)
        best, n = want.get(key, ((points, ident), 0))
        want[key] = ((points, ident) if exact_dedup.better((points, ident), best) else best, n + 1)
    assert {o[3]: ((o[0], o[1]), o[2]) for o in trie.terminals} == want


def test_trie_spills_by_subtree(spark, monkeypatch):
    pairs = [(i, f"text {i % 37} " + "x" * (i % 5)) for i in range(500)]
    monkeypatch.setattr(exact_dedup, "BUDGET", 300)
    assert rows(exact_dedup.dedup(some(spark, pairs))) == sorted(brute.exact(pairs), key=repr)


# Hot keys


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "COOL", 3)
    left = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)] + [(None, 0), (None, 0), (7, 10**6)], "i bigint, k bigint")
    side = left.where("k < 1000").groupBy("k").agg(F.count("*").alias("n"))
    got = common.salted(left, side, ["k"], "i", side, "n")
    assert rows(got, "i", "k", "n") == rows(left.join(side, "k"), "i", "k", "n")
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in text and "broadcast" in text
    nothing = left.where("false")
    assert common.salted(nothing, side.where("false"), ["k"], "i", side.where("false"), "n").count() == 0


def test_hot_groups_give_the_same_results(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "COOL", 2)
    rng = random.Random(5)
    base = "one text that stands very often among all rows of the table"
    pairs = [(i, base + " " * (i % 3)) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(family(rng, 60, 80, 1) * 2)] + [(None, base), (3, base), (3, None)]
    assert rows(exact_dedup.dedup(some(spark, pairs))) == sorted(brute.exact(pairs), key=repr)
    assert exact_dedup.keep_one(some(spark, pairs)).count() == len({k for _, k, *_ in brute.exact(pairs)})
    plain = [(i, t) for i, t in pairs if i is not None and i != 3]
    want = sorted(((i, n, c, c == i) for i, (n, c) in brute.components(plain, 3, 85).items()), key=repr)
    assert rows(minhash.near_duplicates(some(spark, plain))) == want


# Odd rows: null ids, repeated rows, ties, very long texts, clashing names


def repeated(got, *cols):
    """The rows of the id that stands twice are alike; the columns asked for."""
    twice = [tuple(r) for r in got.collect() if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    return sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)


def test_odd_rows_of_every_operator(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (9, None)], "doc_id bigint, quality int").withColumn("stats", F.lit("x"))
    got = quality_model.classify(odd, labels)
    assert got.count() == 9 and all(0 <= s <= 1 for _, s in repeated(got, "doc_id", "score"))
    near = repeated(minhash.near_duplicates(odd), "doc_id", "component_id", "kept")
    assert [r for r in near if r[0] in (5, 6, 7)] == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False)] and near.count((None, None, True)) == 2
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [None, None, 5, 5, 8, 9, 10]))
    assert len(repeated(quality_rules.verdicts(odd), "doc_id")) == 9 and quality_rules.keep(odd).columns == odd.columns
    assert len(repeated(secret_scan.digest(secret_scan.secrets(odd)), "doc_id")) == 9
    assert len(repeated(license_scan.digest(license_scan.licenses(odd)), "doc_id")) == 9
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}[9] == "und"
    assert len(repeated(bpe.digest(odd, tokenizer("word_bpe_49k.json")), "doc_id")) == 9
    assert len(wavelet.round_trip(odd, tokenizer("byte_bpe_50k.json"), 2).collect()) == 9
    mix = mixing.Mix(odd.drop(*[c for c in odd.columns if c.startswith("__")]), ["lang", "source"], budget_ratio=1.0, max_epochs=1)
    assert sum(r["n_tokens"] for r in mix.documents().collect()) == sum(len(brute.words(r["text"])) for r in odd.collect())
    once = exact_dedup.keep_one(odd)
    assert once.columns == odd.columns and sorted(repr(r["doc_id"]) for r in once.collect()) == sorted(map(repr, [None, 6, 8, 9, 10]))


def test_documents_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD", 50)
    tok, pairs = library("byte_bpe_50k.json"), [(i, f"text {i} " * (200 if i == 3 else 4)) for i in range(9)]
    got = rows(wavelet.round_trip(some(spark, pairs), tokenizer("byte_bpe_50k.json"), 2, shards=2), "doc_id", "n_tokens", "ids_crc32")
    assert got == [(i, len(ids), brute.crc(ids)) for i, t in pairs for ids in [[*tok.encode(t, add_special_tokens=False).ids, 2]]]


def test_cut_ranges_are_cut_again(spark, monkeypatch):
    rng = random.Random(27)
    data = [(i, "w " * rng.randrange(0, 9), "a", "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    table, mix = mixed(spark, data, budget_ratio=0.7, max_epochs=2)
    want = rows(mix.documents())
    monkeypatch.setattr(mixing, "SMALL", 1)
    monkeypatch.setattr(mixing, "BIN_DIGITS", 1)
    _, fine = mixed(spark, data, budget_ratio=0.7, max_epochs=2)
    assert fine.digits > 2 and rows(fine.documents()) == want
