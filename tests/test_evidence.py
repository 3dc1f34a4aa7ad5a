"""Evidence, drafts, outlines, versions and memory on small fixtures, against plain rules and expected values."""

import re

import pytest
from pyspark.sql import functions as F

from chalkline.operators import evidence, folds, lifecycle, memory, objectives, ops, outline, sets, validation
from chalkline.plans import drafts as draft_queries


def values(spark, column, texts, name="t"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string").select("i", column.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_display_excerpts(spark):
    long_ = "This sentence is long enough to be cut at a word when it is shown " * 5 + "end."
    texts = ["Here it is. And so on.", "hello there. This one is fine.", "�� ab cd", "One is fine. UNIT 3 is a label. Two are fine. Three are fine too.", long_, "A good one here. ©© Another good line here.", "", "Say it say it again.", "wrongCase is here."]
    found = values(spark, evidence.display_excerpt(F.col("t")), texts)
    assert found[:4] == ["Here it is. And so on.", "This one is fine.", "", "Two are fine. Three are fine too."]
    assert found[4].endswith("…") and len(found[4]) <= 240 and long_.startswith(found[4][:-1])
    assert found[5:] == ["", "", "", ""]


def test_display_fragments(spark):
    text = "Unit 3. This is after a label. ©© A sentence that is shown. A sentence that is shown. Short. ©© The second sentence shown here."
    assert values(spark, evidence.display_fragments(F.col("t")), [text, "No marks at all here."]) == [["A sentence that is shown.", "The second sentence shown here."], []]


def test_cloze(spark):
    quote = "# Hello is a greeting. It is used when friends meet each other in the street or in the school yard at noon! Hello."
    assert values(spark, evidence.cloze_prompt(F.col("t"), F.lit("Hello"), F.lit("en")), [quote]) == ["Complete the textbook sentence: “____ is a greeting.”"]
    assert values(spark, evidence.cloze_answer(F.col("t"), F.lit("hello is a greeting.")), [quote]) == ["greeting"]
    assert values(spark, evidence.cloze_answer(F.col("t"), F.lit("absent")), [quote]) == [None]


def draft(**changed):
    base = dict(draft_id=1, prompt="Which word is a greeting", kind="short_answer", language="zh", difficulty="easy", citations=[1], rationale="greeting", options=[("a", "hello"), ("b", "table")], correct_option_id="a", answers=["hello"], exemplar="hello friend", rubric=[("names it", 1.0)], types=list(validation.KINDS), asked_language="zh", asked_difficulty="easy")
    return base | changed


SCHEMA = "draft_id long, prompt string, kind string, language string, difficulty string, citations array<long>, rationale string, options array<struct<id:string,text:string>>, correct_option_id string, answers array<string>, exemplar string, rubric array<struct<description:string,weight:double>>, types array<string>, asked_language string, asked_difficulty string"
SOURCE = "Hello is a word of greeting, said by a friend. Hello, Sam. Nice to meet you. How are you, Amy? Fine, thanks."
DRAFTS = [
    (draft(), None),
    (draft(prompt="abcdefgh12 is it"), "unreadable_ocr_prompt"),
    (draft(prompt="这个活动叫什么 listen and say 是什么活动"), "non_learning_question"),
    (draft(prompt="什么是 listen and point 吗"), "non_learning_question"),
    (draft(prompt="询问数量: 'nine girls?'"), "quantity_confirmation_mismatch"),
    (draft(prompt="看图片 answer it"), "unsupported_visual_claim"),
    (draft(prompt="课本第 3 页 says"), "unverified_page_reference"),
    (draft(kind="true_false", prompt="What is it"), "invalid_true_false_statement"),
    (draft(kind="true_false", prompt="Hello is a greeting."), None),
    (draft(kind="true_false", prompt="Cats fly.", rationale="no"), "unsupported_answer"),
    (draft(prompt="Say ____ now"), "unexpected_blank_placeholder"),
    (draft(kind="fill_blank", prompt="Say it"), "missing_blank_placeholder"),
    (draft(kind="fill_blank", prompt="____ and ____ it"), "multiple_blank_placeholders"),
    (draft(kind="fill_blank", prompt="What is this? ____"), "open_ended_fill_prompt"),
    (draft(kind="fill_blank", prompt="A: hi B: ____ is it"), "unreadable_cloze_context"),
    (draft(kind="fill_blank", prompt="The word ____ is a greeting word"), None),
    (draft(kind="fill_blank", prompt="Fill in “____ is a table”", answers=["hello"]), "unsupported_fill_phrase"),
    (draft(kind="fill_blank", prompt="The word ____ is one", answers=["hello", "Hello"]), "ambiguous_answers"),
    (draft(kind="fill_blank", prompt="The word ____ is one", answers=["zebra"]), "unsupported_answer"),
    (draft(kind="fill_blank", prompt="The hello word ____ is one"), "answer_leakage"),
    (draft(prompt="他询问 “a b” 然后回答 “c d”"), "unsupported_dialogue_pairing"),
    (draft(types=["fill_blank"]), "type_mismatch"),
    (draft(difficulty="hard"), "request_mismatch"),
    (draft(citations=[]), "invalid_citations"),
    (draft(citations=[1, 1]), "invalid_citations"),
    (draft(citations=[9]), "invalid_citations"),
    (draft(citations=[2]), "insufficient_evidence"),
    (draft(prompt="the pronoun he refers to 爸爸"), "unsupported_coreference"),
    (draft(kind="true_false", prompt="这是一个词。", citations=[3]), "non_learning_question"),
    (draft(prompt="this is near the word"), "unsupported_spatial_claim"),
    (draft(prompt="通过重复来区分 words"), "unsupported_distinction_claim"),
    (draft(prompt='the answer to "How are you, Amy?"', citations=[4]), "ambiguous_dialogue_answer"),
    (draft(prompt="如果有人受伤 what word"), "unsupported_scenario"),
    (draft(kind="multiple_choice", options=[("a", "hello"), ("a", "table")]), "ambiguous_options"),
    (draft(kind="multiple_choice", options=[("a", "hello"), ("b", "Hello ")]), "ambiguous_options"),
    (draft(kind="multiple_choice", prompt="指向哪个单词", options=[("a", "hello"), ("b", "friend")]), "ambiguous_options"),
    (draft(kind="multiple_choice", correct_option_id="z"), "invalid_answer"),
    (draft(kind="multiple_choice", prompt="怎样介绍自己", options=[("a", "I'm"), ("b", "x")]), "incomplete_expression"),
    (draft(kind="multiple_choice", prompt="有人问这是什么", options=[("a", "Hello!"), ("b", "x")]), "dialogue_answer_mismatch"),
    (draft(kind="multiple_choice", prompt="Sam 说了 which words", options=[("a", "Nice to meet you."), ("b", "x")]), "unsupported_speaker_attribution"),
    (draft(kind="multiple_choice", prompt="how does Amy reply", options=[("a", "hello"), ("b", "x")]), "dialogue_answer_mismatch"),
    (draft(kind="multiple_choice", prompt="反问 which words", options=[("a", "hello"), ("b", "x")]), "dialogue_answer_mismatch"),
    (draft(kind="multiple_choice", options=[("a", "zebra"), ("b", "x")]), "unsupported_answer"),
    (draft(kind="multiple_choice", prompt="hello is which word"), "answer_leakage"),
    (draft(kind="multiple_choice"), None),
    (draft(rubric=[("x", 0.4), ("y", 0.4)]), "invalid_rubric"),
    (draft(prompt="list all words", exemplar="hello zebra"), "unsupported_answer"),
    (draft(exemplar="zebra"), "unsupported_answer"),
    (draft(prompt="say hello friend"), "answer_leakage"),
]


def test_texts_do_not_decide_the_cases_of_drafts(spark, tmp_path):
    texts = {12: "so ofathere, it went on", 15: 'then " and on', 37: "a mother and a father", 40: 'a "b', 62: None, 65: ""}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["reason"] for r in draft_queries.draft_reasons(spark, str(tmp_path)).collect()}
    assert found == {12: "unsupported_coreference", 15: "ambiguous_dialogue_answer", 37: "unsupported_coreference", 40: "invalid_citations", 62: "invalid_citations", 65: "type_mismatch"}


def test_every_code_of_drafts(spark):
    rows = [tuple(d[k] if k != "draft_id" else i for k in d) for i, (d, _) in enumerate(DRAFTS)]
    chunks = spark.createDataFrame([(1, SOURCE, "a/数学/b"), (2, "  ", "a"), (3, SOURCE, "小学/英语/x"), (4, "How are you, Amy? Well. How are you, Amy? Fine.", "a")], "chunk_id long, text string, path string")
    found = validation.cite(spark.createDataFrame(rows, SCHEMA), chunks).select("draft_id", validation.reason().alias("reason")).collect()
    wrong = [(DRAFTS[r["draft_id"]][0]["prompt"], r["reason"], DRAFTS[r["draft_id"]][1]) for r in found if r["reason"] != DRAFTS[r["draft_id"]][1]]
    assert len(found) == len(DRAFTS) and not wrong, wrong
    assert {c[4] for c in draft_queries.CASES} - {None} <= {code for _, code in DRAFTS}


def test_batches(spark):
    rows = [(1, 0, "Say it", None, 2), (1, 1, " say  IT ", None, 2), (2, 0, "a", None, 2), (3, 0, "a", None, 2), (3, 1, "b", "answer_leakage", 2), (4, 0, "a", None, 2), (4, 1, "b", None, 2)]
    found = validation.batch_state(spark.createDataFrame(rows, "batch int, place int, prompt string, reason string, asked int"), "batch", "asked").collect()
    assert {r["batch"]: r["state"] for r in found} == {1: "duplicate_question", 2: "count_mismatch", 3: "answer_leakage", 4: "valid"}


def test_objectives(spark):
    near = objectives.near_duplicate(F.col("a"), F.col("b"))
    rows = [("Name the family members in a picture", "Name the family members in the picture", True), ("Use father in a sentence frame", "Use brother in a sentence frame", False), ("Introduce yourself", "Say your own name", True), ("Count to ten", "Recite the numbers", True)]
    assert [r["v"] for r in spark.createDataFrame(rows, "a string, b string, x boolean").select(near.alias("v")).collect()] == [r[2] for r in rows]
    assert sorted(values(spark, objectives.tokens(F.col("t")), ["认识数字 and words"])[0]) == sorted(["认识", "识数", "数字", "words"])


def test_outline_depths_and_ranges(spark):
    """Two levels of 39 nodes, with a tail that isn't taught."""
    rows = [(0, i, f"Module {i // 3 + 1}" if i % 3 == 0 else f"Unit {i % 3}", 2 + i * 2, 0 if i % 3 == 0 else 1 if i % 6 < 3 else 3, 80, 80) for i in range(33)]
    rows += [(0, 33 + k, "Words and Expressions in Each Module" if k == 0 else f"Appendix {k}", 71 + k, 0, 80, 80) for k in range(6)]
    books = spark.createDataFrame(rows, "book int, ordinal long, title string, page_start int, depth int, n_pages int, last_page int")
    found = {r["ordinal"]: r for r in outline.nodes(books).collect()}
    stack, expected = {}, {}
    for _, n, _, _, depth, _, _ in rows:
        while depth and depth - 1 not in stack:
            depth -= 1
        expected[n] = depth, stack.get(depth - 1) if depth else None
        stack = {k: v for k, v in stack.items() if k < depth} | {depth: n}
    assert {n: (r["depth"], r["parent"]) for n, r in found.items()} == expected
    assert [tuple(r) for r in outline.instruction_range(outline.nodes(books)).collect()] == [(0, 2, 70)]
    ends = {r["ordinal"]: r["page_end"] for r in outline.page_ranges(outline.nodes(books)).collect()}
    assert ends[0] == 7 and ends[32] == 70 and ends[38] == 80


def test_embed_batches(spark):
    chunks = spark.createDataFrame([(i, 1, i, None if i % 2 else "pending") for i in range(65)] + [(100, 1, 100, "m")], "chunk_id long, source_id long, ordinal long, model string")
    sources, members = spark.createDataFrame([(1, "unit1/slides.pdf")], "source_id long, path string"), spark.createDataFrame([(1, 1)], "version_id long, source_id long")
    sizes = lifecycle.embed_feed(chunks, sources, members, "m").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [32, 32, 1]
    with pytest.raises(Exception, match="another size"):
        lifecycle.vector_upsert(spark.createDataFrame([(1, [0.0, 1.0])], "chunk_id long, vector array<double>"), spark.createDataFrame([(2, [0.0])], "chunk_id long, vector array<double>"), dim=2).collect()


def test_promotion_merges_and_conflicts(spark):
    rows = [(1, "k", 1, "step by step explanations", 1, 0.5), (1, "k", 2, "step by step explanation", 2, 0.9), (1, "k", 3, "brief answers", 3, 0.4), (1, "k", 4, "brief answers", 4, 0.6), (1, "j", 5, "x", 5, 0.1)]
    found = memory.promote(spark.createDataFrame(rows, "user_id int, fact_key string, n int, value string, turn long, confidence double"), ["user_id", "fact_key"], [F.col("n")]).collect()
    assert sorted((r["fact_key"], r["fact_no"], r["value"], r["status"], r["evidence"], r["confidence"]) for r in found) == [("j", 1, "x", "active", 1, 0.1), ("k", 1, "step by step explanations", "conflicted", 2, 0.9), ("k", 2, "brief answers", "conflicted", 1, 0.4), ("k", 3, "brief answers", "active", 1, 0.6)]


def test_circuit_and_windows(spark):
    calls = spark.createDataFrame([(1, i, at, failed) for i, (at, failed) in enumerate([(0, True), (1, True), (2, True), (3, False), (31, False), (32, True), (40, False)])], "route int, call_id long, at long, failed boolean")
    found = {r["call_id"]: r["outcome"] for r in ops.circuit(calls, "route", "at", ["at"], "failed").collect()}
    assert [found[i] for i in range(7)] == ["failed", "failed", "failed", "rejected", "rejected", "failed", "ok"]
    hits = spark.createDataFrame([(1, f"2024-01-01 00:00:{s:02}") for s in (50, 55, 59)] + [(1, "2024-01-01 00:01:10"), (1, "2024-01-01 00:01:55")], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r["hits"]) for r in ops.over_limit(hits, "k", "ts", 60, 3).collect()] == [4]


def test_folds_stream_over_batches(spark):
    rows = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    found = folds.ordered_fold(rows, ["k"], [F.col("n")], "total bigint, last bigint", lambda: {"t": 0}, lambda s, r: s.update(t=s["t"] + 1, last=r["n"]) or (), lambda s: [(s["t"], s["last"])])
    assert sorted(tuple(r) for r in found.collect()) == [(0, 16667, 49998), (1, 16667, 49999), (2, 16666, 49997)]


def test_name_uuids(spark):
    import uuid

    names = ["practice-set:1", "exercise:x:0", "日本"]
    assert values(spark, sets.name_uuid(F.col("t")), names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_grounding_keeps_texts_out_of_sorts(spark):
    chunks = spark.createDataFrame([(1, 1, 10, "Alpha beta"), (1, 2, 11, "gamma  DELTA"), (1, 3, 12, "alpha gamma"), (3, 1, 30, "omega")], "job_id long, place int, chunk_id long, text string")
    rows = [(1, 1, [10], ["alpha"]), (2, 1, [10], ["alpha", "Gamma delta"]), (3, 1, [12], ["alpha", "gamma"]), (4, 1, [12, 99], ["alpha"]), (5, 1, [10], ["alpha", "zeta"]), (6, 1, [10], []), (7, 2, [10], ["alpha"]), (8, 1, [12], ["a"]), (2, 3, [30], ["omega"])]
    found = validation.repair_grounding(spark.createDataFrame(rows, "draft_id long, job_id long, citations array<long>, answers array<string>"), chunks)
    assert sorted((r["draft_id"], r["citations"]) for r in found.collect()) == [(1, [10]), (2, [10, 11]), (2, [30]), (3, [12]), (4, [10]), (5, [10]), (6, [10]), (7, [10]), (8, [12])]
    nodes = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "ShuffledHashJoin" in nodes and "SortAggregate" not in nodes


def test_cloze_finds_the_sentences_once(spark):
    quote = "## A hello is a word here. So is hello in this one too. " + "x" * 94 + " hello. Or hello .. it is a word."
    rows = [(1, quote, "hello"), (2, quote, "absent"), (3, None, "hello"), (4, "", "hello"), (5, "One more word.", ""), (6, quote, None), (7, "Hello is one word. hello as one word.", "HELLO"), (8, "Say it, hello, " + "y" * 84 + ".", "hello"), (9, "Say it, hello, " + "y" * 85 + ".", "hello")]
    found = spark.createDataFrame(rows, "i int, q string, a string").select("i", evidence.cloze_prompt(F.col("q"), F.col("a"), F.lit("en")).alias("v"))
    shown = lambda t: f"Complete the textbook sentence: “{t}”"
    expected = [shown("A ____ is a word here."), None, None, None, shown("____One more word."), None, shown("____ is one word."), shown("Say it, ____, " + "y" * 84 + "."), None]
    assert [r["v"] for r in sorted(found.collect(), key=lambda r: r["i"])] == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^.!?]+") == 1


def test_sentences_are_split_behind_stops_once(spark):
    texts = ["", "One. Two!? Three", "...One. ", "?！", "这是。那是？ And one. ！end", "No stop", "a.b。。c!?d", None]
    pattern = re.compile("[^.!?。！？]+(?:[.!?。！？]+|$)")
    assert values(spark, evidence.behind_stops(F.col("t")), texts) == [None if t is None else pattern.findall(t) for t in texts]
    docs = spark.createDataFrame([(1, "It's good to one two one two here. It's good to see them here again."), (2, "ABC DEF is good. Here is the wordCase of one. LISTEN and see it here."), (3, "© Here is 这是一个 line. Also one ® it is so good. © Now Its x'Y z here.")], "i int, t string")
    found = evidence.displayed(docs, F.col("t"))
    assert [(r["excerpt"], r["fragments"]) for r in found.orderBy("i").collect()] == [("It's good to see them here again.", []), ("ABC DEF is good.", []), ("", ["Here is 这是一个 line.", "Now Its x'Y z here."])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(__text") == 1
