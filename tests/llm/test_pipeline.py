"""The corpus pipeline, stage by stage, against plain Python on each stage's input."""

from collections import Counter

import brute
import corpus_pipeline
import pytest
from test_training_operators import encode_with, items_of

from chalkline.llm import mixing, registry
from chalkline.sources.scratch import scratch_table
from chalkline.sources.tables import table


@pytest.mark.parametrize("which", ["odd", "sf0.001"])
def test_stages(spark, odd, sf, which, tmp_path):
    folder = odd[0] if which == "odd" else sf
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = Counter(r[0] for r in out.select("doc_id").collect())
        if name == "quality rules":
            expected = Counter(r[0] for r in brute.host_rules(rows) if r[-1])
        elif name == "near-duplicates":
            expected = Counter(d for d, x in brute.near_groups([r[:2] for r in rows]).items() if x[2])
        elif name == "decontamination":
            expected = Counter(r[0] for r in brute.contaminated([r[:2] for r in rows], items_of(folder)) if not r[-1])
        elif name == "mixture":
            taken, _ = mixing.mix_sources(docs)
            expected = Counter({r.doc_id: n for r in taken.collect() if r.size and (n := int(r.taken / r.size + 0.5))})
        else:
            rows.sort(key=lambda r: r[0])
            assert sorted(tuple(r) for r in out.collect()) == sorted(brute.token_rows([r[:2] for r in rows], encode_with(registry.tokenizer_path())))
            return
        assert ids == expected
        assert out.columns == columns
        docs = out


def test_run(spark, sf):
    result = corpus_pipeline.run(spark, sf)
    assert result.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and result.count() > 50


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_repeated_rows(spark, tmp_path):
    """Repeated rows of one id and text become one, and null ids stay."""
    from conftest import save

    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(60))
    rows = [(5, base, "a")] * 3 + [(7, base, "a"), (6, other, "a"), (6, base + " x", "b"), (None, base, "a"), (None, base, "a"), (9, None, None), (9, None, None), (10, "", "a")]
    folder = save(tmp_path, rows)
    docs = table(spark, folder, "documents")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, base), (None, base), (None, base), (9, None), (10, "")])


def test_the_smallest_of_repeated_rows_stays(spark, tmp_path):
    from conftest import save

    base = " ".join(f"word{i}" for i in range(60))
    rows = [(5, base, s) for s in ("z", "b", None, "m", "b")] + [(6, base + " tail", "y")]
    docs = table(spark, save(tmp_path, rows), "documents")
    for order in (docs, docs.orderBy("source"), docs.orderBy(docs["source"].desc()).repartition(3)):
        (kept,) = corpus_pipeline.near_duplicate_stage(spark, order, str(tmp_path)).collect()
        # lang comes before source in the table, and nulls are smallest
        assert (kept.doc_id, kept.lang, kept.source) == min(((r.doc_id, r.lang, r.source) for r in docs.collect() if r.doc_id == 5), key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))


def test_repeated_and_null_ids_in_every_stage(spark, repeated):
    folder, _ = repeated
    docs = table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = scratch_table(stage(spark, docs, folder), "stage")
        ids = Counter(r[0] for r in out.select("doc_id").collect())
        if name == "quality rules":
            assert ids == Counter(r[0] for r in brute.host_rules(rows) if r[-1])
        elif name == "near-duplicates":
            named = [r[:2] for r in rows if r[0] is not None]
            merged = {}
            for d, t in named:  # an id's texts are one document: all of them or none stay
                merged.setdefault(d, set()).add(t)
            assert set(ids) - {None} <= set(merged) and ids[None] == sum(r[0] is None for r in rows)
            assert all(n == len(merged[d]) for d, n in ids.items() if d is not None)
        elif name == "decontamination":
            assert ids == Counter(r[0] for r in brute.contaminated([r[:2] for r in rows], items_of(folder)) if not r[-1])
        elif name == "mixture":
            size, took = Counter(), Counter()
            for r in mixing.mix_sources(docs)[0].collect():
                size[r.doc_id] += r.size
                took[r.doc_id] += r.taken
            each = Counter(r[0] for r in rows)
            assert ids == Counter({d: int(took[d] / size[d] + 0.5) * each[d] for d in each if size[d] and int(took[d] / size[d] + 0.5)})
        else:
            found, expected = [tuple(r) for r in out.collect()], brute.token_rows([r[:2] for r in rows], encode_with(registry.tokenizer_path()))
            by_id = lambda x: Counter((r[0], r[2], r[3]) for r in x)  # noqa: E731  rows of one id are in any order
            assert by_id(found) == by_id(expected)
            return
        assert out.columns == columns
        docs = out
