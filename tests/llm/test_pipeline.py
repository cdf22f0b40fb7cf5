"""Each stage of the corpus pipeline on its own input, and the whole of it."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as p
import pytest
from tokenizers import Tokenizer

from merchlake.llm import op9_secrets as secrets
from merchlake.llm.op5_mixing import mix
from merchlake.llm.op8_simhash import fingerprint_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows of `documents` and what each stage makes of what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_language_stage_keeps_rows_as_they_are(steps):
    before, after = ({r["doc_id"]: r for r in rows(d)} for d in steps[:2])
    assert steps[1].columns == steps[0].columns
    assert all(before[d] == r for d, r in after.items())
    assert len(after) >= 0.97 * len(before)


def test_one_of_each_group_of_near_duplicates_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    fps = {r["doc_id"]: fingerprint_of(r["text"]) for r in before}
    ids = sorted(fps)
    up = {d: d for d in ids}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert sorted(r["doc_id"] for r in after) == sorted({top(d) for d in ids})


def test_secrets_are_gone_and_nothing_else(steps):
    before, after = ({r["doc_id"]: r for r in rows(d)} for d in steps[2:4])
    assert before.keys() == after.keys()
    import re

    for d, r in after.items():
        if r["text"] == before[d]["text"]:
            assert r == before[d]
            assert not re.search(f"{secrets.ACCESS}|{secrets.HEX}", r["text"])
        else:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])


def test_mixture_is_what_mix_says(steps):
    want = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mix(steps[3]).collect()}
    got = Counter(r["doc_id"] for r in rows(steps[4]))
    assert got == Counter({d: n for d, n in want.items() if n})
    words = defaultdict(int)
    for r in rows(steps[4]):
        words[r["source"]] += len(r["text"].split())
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mix(steps[3]).select("source", "target", "source_size").distinct().collect()}
    assert all(abs(words[s] - t) <= 0.25 * size for s, (t, size) in targets.items())


def test_sequences_hold_every_token(steps):
    from collections import Counter

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = Counter()
    for r in rows(steps[4]):
        want[r["doc_id"]] += len(own.encode(r["text"], add_special_tokens=False).ids) + 1
    got, places = Counter(), defaultdict(list)
    for r in rows(steps[5]):
        got[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_rows_of_the_stages(spark, steps):
    key = lambda d: sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows(d))
    assert key(p.run(spark, SF)) == key(steps[5])


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five", "en", "a", 23, "x"), (1, "one two three four five", "en", "a", 23, "x"), (2, None, None, None, None, "x"), (None, "", "en", "b", 0, "x"), (3, "token=abcdefghij and more", "en", "a", 25, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, identity string",
    )
    for _, stage in p.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            assert stage(spark, d, "").columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in p.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [(1, "one two three four five"), (2, ""), (3, "token=abcdefghij and more")]
    assert sorted(r["text"] or "" for r in p.redact_secrets(spark, docs, "").collect())[-1] == "one two three four five"
    assert zlib.crc32(b"x") and p.pack_sequences(spark, docs.limit(0), "").count() == 0


def test_columns_of_any_name_come_through(spark):
    names = ["base", "spans", "row", "clean", "found", "identity", "times", "whole", "random"]
    docs = spark.createDataFrame([(1, "token=abcdefghij and more", "en", "a", 25, *names)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    (got,) = p.redact_secrets(spark, docs, "").collect()
    assert got["text"] == "[SECRET] and more" and got["n_chars"] == len(got["text"])
    assert [got[n] for n in names] == names
    for _, stage in p.STAGES[:-1]:
        (got,) = stage(spark, docs, "").select(*names).distinct().collect()
        assert list(got) == names
