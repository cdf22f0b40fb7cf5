"""Packing: exact pieces, sound placement, few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from merchlake.llm.op4_packing import _encoder, pack, plan

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack(docs, VOCABULARY).collect()
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    want = {}
    for doc, text in docs.select("doc_id", "text").collect():
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for i, a in enumerate([0, *range(first, len(ids), 2048)]):
            piece = ids[a : a + (first if i == 0 else 2048)]
            want[doc, i] = (a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    used, least = check_places(rows, 2048), -(-sum(length for _, length, _ in want.values()) // 2048)
    assert used <= 1.02 * least + 1


def test_plan_places_every_piece_once_and_closely():
    rng = random.Random(3)
    for trial in range(60):
        capacity = rng.choice([7, 30, 100, 2048])
        counts = {s: rng.choice([1, 2, 3, 50, 1000]) for s in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 60)))}
        got, load, seen = defaultdict(set), defaultdict(list), 0
        for size, first, last, each, sequence, offset in plan(counts, capacity):
            for number in range(first, last + 1):
                assert number not in got[size]
                got[size].add(number)
                load[sequence + (number - first) // each].append((offset + (number - first) % each * size, size))
                seen += 1
        assert {s: set(range(n)) for s, n in counts.items()} == dict(got)
        for places in load.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= capacity
        large = [s for s, n in counts.items() for _ in range(n) if 3 * s > capacity]
        least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(2 * s > capacity for s in large))
        assert len(load) <= 1.25 * least + 2, (trial, capacity, len(load), least)


def test_special_strings_and_long_runs_go_through_the_tokenizer():
    encode = _encoder(VOCABULARY)
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    for text in ["", "a<|endoftext|>b", "x" * 30_000, " \n\t  z", "日本語 \U0001f600 ĀĂ", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, " \t" * 3000 + "x"]:
        assert list(encode(text)) == own.encode(text, add_special_tokens=False).ids


def test_edge_cases(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b c " * 3000, 3), (2, "a b c " * 3000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    got = pack(docs, VOCABULARY).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in got)[:3] == [(0, 0, 1), (1, 0, 1), (1, 0, 1)]
    check_places(got, 2048)
    assert pack(docs.limit(0), VOCABULARY).collect() == []


def test_a_document_that_is_there_very_often_is_dealt_to_many_groups(spark, monkeypatch):
    from merchlake.llm import op4_packing as op

    monkeypatch.setattr(op, "GROUP_ROWS", 4)
    docs = spark.createDataFrame([(7, "the very same words")] * 3000 + [(i, "a b " * i) for i in range(50)], "doc_id long, text string")
    groups = []
    keep = op.Scratch.keep

    def watched(self, df, label="t"):
        out = keep(self, df, label)
        if label == "counts":
            groups.extend(r["n"] for r in out.collect())
        return out

    monkeypatch.setattr(op.Scratch, "keep", watched)
    got = pack(docs, VOCABULARY).collect()
    assert len(got) == 3050 and max(groups) < 40
    check_places(got, 2048)
