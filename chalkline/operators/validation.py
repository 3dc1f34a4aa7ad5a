"""Checks of drafted questions against their request and cited evidence: the first that fails gives the reason.

Texts come in compatibility form (``functions.text.clean_unicode``); comparisons use lower case and single spaces.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X

KINDS = ("multiple_choice", "true_false", "fill_blank", "short_answer")
# The patterns of the checks, by what they look for.
OCR_GARBAGE = r"[�¢§®©]|\\\[_+\]+\]|\b[A-Za-z]{8,}\d+[A-Za-z]*\b|\b[A-Z]:\s*\|[A-Za-z]\b"
METADATA = (
    r"标题|课题|篇名|后记|编者|出版说明|学习目标|教学目标|\b(?:title|heading|page number|learning objective)\b",
    r"(?:教材|课文|课本|文本)(?:中|里)(?:反复|多次|曾经|经常)?(?:出现|提及|提到|包含|包括|收录)(?:了|过|的)?.{0,55}(?:单词|词语|短语|表达|句子|指令|物品|事物)|\b(?:appears?|occurs?|is found) in (?:the )?(?:textbook|text)\b",
    r"(?:这|本|第\s*\d+\s*)页.{0,12}(?:叫什么|是什么活动|是哪(?:个|一)活动|是否出现)",
    r"(?:教材|课本|课文).{0,80}(?:物品|事物|对象).{0,20}(?:包括|包含|有)",
    r"(?:教材|课本|课文)(?:中|里)?(?:明确)?要求.{0,25}(?:指向|指出)",
    r"(?:出现|属于|收录|位于).{0,24}(?:哪(?:个|种|一)|什么).{0,10}(?:单元|模块|章节|活动|练习|栏目|环节)|(?:单元|模块|章节|活动|练习|栏目|环节)(?:的)?(?:名称|名字|标题)(?:是)?(?:什么|哪(?:个|一))|(?:在哪(?:个|一)?)(?:单元|模块|章节)(?:中|里|出现|收录|学习)?|(?:属于|是).{0,12}(?:哪(?:种|个|一)|什么)(?:活动|练习|栏目|环节)(?:类型)?",
)
ACTIVITY = r"listen and say|listen and repeat|listen and point|look and say|read and write"
ACTIVITY_BEFORE, ACTIVITY_ASKED = r"(?:是|有|出现|包含|包括|叫|写着)", r"(?:(?:这个)?(?:活动|栏目|环节))?(?:吗|\?|？|$)"
ACTIVITY_AFTER = r"(?:是(?:什么|哪(?:个|一))(?:活动|栏目|环节)|叫什么|出现了?(?:吗|\?|？)|吗)"
QUANTITY_ASKED, QUANTITY_CONFIRMED = r"询问.{0,16}数量|\bask(?:ing)? (?:for|about) (?:the )?(?:number|quantity)\b", r"确认|核实|核对|是否|\bconfirm(?:ing)?\b"
QUANTITY_QUOTED = r"['‘“\"](?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+[a-z]+s\?['’”\"]"
VISUAL = r"(?:在|看|观察|根据).{0,8}(?:图片|图画|插图|图中)|(?:图片|图画|插图|画面)(?:中|里|上|所画|显示)|\b(?:picture|image|illustration)\b"
POINTING = r"(?:有人|某人|说话者|人物|角色|他|她).{0,16}(?:指着|指向)"
PAGE_REFERENCE = r"(?:课本|教材|课文)?第\s*\d+\s*页"
NOT_A_CLAIM = (
    r"(?i)^(?:(?:这句话|该句|上述句子)\s*(?:表明|说明|意味着)|(?:this sentence|this statement)\s+(?:shows|means|indicates))",
    r"(?:可能|应该)?会说(?:什么)?\s*$",
    r"(?:_{2,}|＿{2,}|\.{2,}|…+)\s*$",
    r"(?:正确的回答|答案|英文表达|英语表达)(?:应该)?是(?:什么|哪(?:个|一)?句(?:话)?)(?:[。.!！\s]*)$",
    r"(?i)^(?:what|who|where|why|how|which|is|are|do|does|can|could|would|should)\b",
)
LISTED_CLAIMS = r"(?i)还有|以及|并且|同时|另外|\band also\b"
BLANK = r"_{2,}|＿{2,}|\[\s*\]|[（(]\s*[）)]"
OPEN_FILL = (
    r"_{2,}.{0,35}(?:这句话|这句表达).{0,12}(?:意思|含义|表达什么)",
    r"(?:哪些|列出).{0,30}(?:单词|词语|数字|身体部位)",
    r"[?？]\s*_{2,}\s*[。.?!！？]*$",
    r"[\"'“‘]\s*_{2,}\s*[\"'”’]",
    r"(?:句子|单词|短语|表达|指令)(?:是|为)\s*_{2,}\s*[。.?!！？]*$",
)
TURN, MERGED_TURN = r"\b[A-Z]:\s*", r"(?i)\b(?:and|or|the|a|an)\s+[.,!?]\s+[A-Za-z]"
ASKED, REPLIED, QUOTE = r"询问|提问|有人问|对方问|问[\"'“‘你他她]", r"回答|答道|回应|回复|答复", r"[“\"]([^”\"]+)[”\"]|[‘]([^’]+)[’]"
ASKED_EN, REPLIED_EN = r"\b(?:ask|asked|asks|question)\b", r"\b(?:answer|answered|reply|respond)\b"
PRONOUN = r"(?i)(?:代词|\bpronoun\b).{0,12}(?<![A-Za-z])(?:he|she)(?![A-Za-z]).{0,16}(?:指代|refers? to)"
FAMILY = {"父亲": "father", "爸爸": "father", "母亲": "mother", "妈妈": "mother", "祖父": "grandpa", "祖母": "grandma", "哥哥": "brother", "弟弟": "brother", "姐姐": "sister", "妹妹": "sister"}
THIS_THAT, NEAR, FAR = r"(?<![a-z])(?:this|that)(?![a-z])", r"近处|附近|\bnear(?:by)?\b", r"远处|远方|\bfar(?:away)?\b|\bdistant\b"
CHANTED, DISTINCT = r"通过.{0,16}重复.{0,16}(?:区分|辨别|区别)", r"(?i)区分|辨别|区别|不同|\b(?:different|difference|distinguish|contrast)\b"
REPLY_ASKED, TURN_NAMED = r"如何回答|怎么回答|回答(?:是|了|什么)|标准回答|正确回答|对应(?:的)?回答|如何回应|\b(?:reply|answer)\b", r"(?i)第一次|第二次|第一轮|第二轮|first time|second time"
QUOTED_QUESTION = r"(?<![A-Za-z])['\"“‘](.{1,120}?[?？])['\"”’]"
INJURY_ASKED, INJURY = r"(?:如果|假如).{0,30}(?:受伤|疼痛|出现问题)", r"(?i)受伤|疼痛|出现问题|\b(?:hurt|injured|pain|problem)\b"
POINT_TO, ORDERED = r"(?:指向|指出).{0,30}(?:哪个|哪一个|以下哪个)单词", r"(?i)首先|第一个|最后|不在|不是|first|last|not"
INTRODUCED, FRAME_ASKED = r"介绍自己|自我介绍|\bintroduc(?:e|ing) (?:oneself|yourself|himself|herself)\b", r"缩写|结构|句型|形式|\b(?:contraction|contracted form|sentence frame)\b"
FRAMES = ("i'm", "im", "i am", "my name is")
OBJECT_ASKER, OBJECT_ASKED, WHAT_IS_THIS = r"询问|有人问|对方问|\b(?:ask|asked|asks)\b", r"这是什么|物品是什么|what(?:'s| is) this|是否是|是不是|is it", r"这是什么|物品是什么|what(?:'s| is) this"
GREETING, YES_NO = r"^(?:hello|hi|goodbye|bye|thank you)\b", r"^(?:yes|no)\b"
TITLED, SPOKE = r"(?:Mr|Mrs|Ms)\.?\s+[A-Z][a-z]+", r"(?:询问|提问|问(?:道|了)?|说(?:道|了)?|使用)"
GREETED = r"(?i)\b(?:hello|hi|good morning|good afternoon|good evening)[,! ]+([A-Z][a-z]{2,})[.!?,]\s*([^.!?]{2,80}[.!?])"
MENTIONED = r"(?:打招呼|询问|提问|问候|问(?:道|了|对方)?|说(?:道|了|的)?|使用)"
NAMED_REPLY_ASKED, NAME = r"(?i)(?:如何|怎么|怎样)?回答|回应|回复|\brespond\b|\breply\b", r"(?<![A-Za-z])([A-Z][a-z]{2,})(?![A-Za-z])"
ASKS_BACK = r"反问|ask back|ask in return"
QUOTED_FILL = r"[\"“]([^\"”]*_{2,}[^\"”]*)[\"”]"
LIST_ALL, LIST_STOPS = r"列出(?:所有|全部)|(?:所有|全部).{0,20}(?:哪些|列出)|\blist all\b", ("and", "are", "for", "from", "into", "that", "the", "these", "this", "with")
KEYWORD = r"([a-z]{3,}|[一-鿿]{2,})"


def normal(c: Column) -> Column:
    return F.lower(X.compact(c))


def has(c: Column, *patterns: str) -> Column:
    """Does any of the patterns occur? Classes of characters are those of Unicode."""
    return reduce(lambda a, b: a | b, (F.rlike(c, F.lit("(?U)" + p)) for p in patterns))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(group))


def contains_answer(text: Column, answer: Column) -> Column:
    """Does the text, in normal form, hold the answer?"""
    return (F.length(normal(answer)) >= 2) & F.contains(text, normal(answer))


def keywords(c: Column) -> Column:
    return F.array_distinct(found(c, KEYWORD))


def about_metadata(p: Column) -> Column:
    """Asks about titles, pages and activities instead of what they teach."""
    asked_after = rf"(?:{ACTIVITY})[\s\"'”’]*{ACTIVITY_AFTER}"
    asked_around = rf"{ACTIVITY_BEFORE}[\s\"'“‘]*(?:{ACTIVITY})[\s\"'”’]*{ACTIVITY_ASKED}"
    return has(p, *METADATA, asked_after, asked_around)


def is_claim(prompt: Column) -> Column:
    """A complete statement, as true/false needs."""
    stem = F.trim(prompt)
    ended = F.rtrim(stem, F.lit("。.!！ "))
    listed = (F.regexp_count(stem, F.lit("[,，;；]")) >= 2) & has(stem, LISTED_CLAIMS)
    return (stem != "") & ~has(ended, "[?？:：]$") & ~has(stem, *NOT_A_CLAIM) & ~listed


def pairs_quotes(prompt: Column, p: Column) -> Column:
    """Claims that one quoted line answers another one."""
    at = lambda c, p: F.regexp_instr(c, F.lit("(?U)" + p))
    first = at(prompt, QUOTE)
    rest = first + F.length(F.regexp_extract(prompt, "(?U)" + QUOTE, 0))
    next_ = at(F.substring(prompt, rest, F.length(prompt)), QUOTE)
    two, asked, replied = (first > 0) & (next_ > 0), at(prompt, ASKED), at(prompt, REPLIED)
    english = has(p, ASKED_EN) & has(p, REPLIED_EN)
    return two & F.when((asked > 0) & (replied > 0), (asked < first) & (first < replied) & (replied < rest + next_ - 1)).otherwise(english)


def repeated_question(prompt: Column, source: Column) -> Column:
    """Asks for the reply to a quoted question that the source has several times."""
    times = lambda q: (F.length(source) - F.length(F.replace(source, normal(q), F.lit("")))) / F.length(normal(q))
    return has(prompt, REPLY_ASKED) & ~has(prompt, TURN_NAMED) & F.exists(found(prompt, QUOTED_QUESTION), lambda q: times(q) > 1)


def several_pointed(prompt: Column, options: Column, source: Column) -> Column:
    """Asks to point to a word, and the source has several of the options."""
    word = lambda o: F.concat(F.lit(r"(?U)(?<!\w)\Q"), normal(o), F.lit(r"\E(?!\w)"))
    there = F.filter(options, lambda o: (F.length(F.trim(o["text"])) >= 2) & F.rlike(source, word(o["text"])))
    return has(prompt, POINT_TO) & ~has(prompt, ORDERED) & (F.size(there) > 1)


def mismatched_reply(p: Column, answer: Column) -> Column:
    """A greeting for an object's name, or yes and no for what it is."""
    a = normal(answer)
    return has(p, OBJECT_ASKER) & has(p, OBJECT_ASKED) & (has(a, GREETING) | (has(p, WHAT_IS_THIS) & has(a, YES_NO)))


def misattributed(prompt: Column, answer: Column, source: Column) -> Column:
    """Names a speaker of the answer whom the source introduces later only, or who is merely greeted before it."""
    low, said = F.lower(source), F.lower(answer)
    last_end = F.length(low) - F.instr(F.reverse(low), F.reverse(said)) + 1
    speakers = found(prompt, rf"(?i)(?<![A-Za-z])({TITLED})(?![A-Za-z])(?=.{{0,4}}{SPOKE})")
    later = lambda name: (F.instr(low, F.lower(name)) > 0) & (F.instr(low, said) > 0) & (last_end < F.instr(low, F.lower(name)) - 1)
    bare = lambda c: F.rtrim(normal(c), F.lit("?!."))
    mention = lambda n: F.concat(F.lit(r"(?iU)(?<!(?:向|对|问)\s{0,2})(?<![A-Za-z])"), n, F.lit(rf"(?![A-Za-z]).{{0,35}}{MENTIONED}"))
    labelled = lambda n: F.rlike(source, F.concat(F.lit(r"(?iU)(?<![A-Za-z])"), n, F.lit(r"\s*[:：]\s*\Q"), answer, F.lit(r"\E")))
    greeted = F.arrays_zip(found(source, GREETED, 1).alias("name"), found(source, GREETED, 2).alias("reply"))
    wrong = F.exists(greeted, lambda g: F.rlike(prompt, mention(g["name"])) & (bare(answer) == bare(g["reply"])) & ~labelled(g["name"]))
    return F.exists(speakers, later) | wrong


def other_named_reply(prompt: Column, answer: Column, source: Column) -> Column:
    """The source replies something else to a question to the one who is named."""
    names = F.filter(found(prompt, NAME), lambda n: ~n.isin("Mr", "Mrs", "Ms"))
    reply = lambda n: F.regexp_extract_all(source, F.concat(F.lit(r"(?iU)\b"), n, F.lit(r"\s*\?(?=\s*([^.!?]{1,100}[.!?]))")), F.lit(1))
    return has(prompt, NAMED_REPLY_ASKED) & F.exists(names, lambda n: F.exists(reply(n), lambda r: normal(r) != normal(answer)))


def bare_introduction(p: Column, answer: Column) -> Column:
    return has(p, INTRODUCED) & ~has(p, FRAME_ASKED) & F.rtrim(normal(answer), F.lit(".!?")).isin(*FRAMES)


def lacks_question_back(p: Column, answer: Column) -> Column:
    return has(p, ASKS_BACK) & ~has(answer, "[?？]")


def unprinted_fill(prompt: Column, answers: Column, source: Column) -> Column:
    """A quoted phrase with a blank that the source doesn't have with any of the answers."""
    filled = lambda t, a: F.contains(source, normal(F.call_function("array_join", F.split(t, "_{2,}"), a)))
    return F.exists(found(prompt, QUOTED_FILL), lambda t: F.rlike(t, F.lit("(?i)[a-z]{2,}")) & ~F.exists(answers, lambda a: filled(t, a)))


def unlisted_terms(p: Column, answer: Column, rubric: Column, source: Column) -> Column:
    """Terms of an 'all of them' answer that the source doesn't have (a difference of sets)."""
    words = lambda c: F.array_distinct(found(c, "([a-z]{3,})"))
    extra = F.array_except(F.array_except(words(normal(F.concat_ws(" ", answer, rubric))), F.array(*map(F.lit, LIST_STOPS))), words(source))
    return has(p, LIST_ALL) & (F.size(extra) > 0)


def question_fingerprint(prompt: Column) -> Column:
    """The prompt in compatibility form, folded, with single spaces."""
    return X.nfkc_casefold(prompt)


def storage_fingerprint(kind: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\0"), prompt), 256)


def cite(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drafts (draft_id, citations, ...) with ``source`` (cited texts in order), ``n_known`` citations and ``english`` (an English book is cited).

    chunks (chunk_id, text, path). One equal join on the citations.
    """
    each = drafts.select("draft_id", F.posexplode("citations").alias("place", "chunk_id")).join(chunks.select("chunk_id", F.col("text").alias("__t"), F.col("path").alias("__p")), "chunk_id")
    held = each.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("place", "__t"))).alias("ts"), F.count(F.lit(1)).cast("int").alias("n_known"), F.bool_or(F.contains("__p", F.lit("/英语/"))).alias("english"))
    held = held.select("draft_id", F.array_join(F.transform("ts", lambda t: t["__t"]), " ").alias("source"), "n_known", "english")
    joined = drafts.join(held, "draft_id", "left").withColumns({"source": F.coalesce("source", F.lit("")), "n_known": F.coalesce("n_known", F.lit(0)), "english": F.coalesce("english", F.lit(False))})
    # Normalised once: as array elements, since the optimizer would put the expressions into each of the checks
    return joined.withColumn("__normal", F.explode(F.array(F.struct(normal(F.col("prompt")).alias("p"), normal(F.col("source")).alias("s")))))


def reason() -> Column:
    """The first failing check of a cited draft, null for a good one.

    Columns: prompt, kind, language, difficulty, citations, rationale, options (id, text), correct_option_id, answers,
    exemplar, rubric (description, weight); types, asked_language, asked_difficulty of the request; those of ``cite``.
    """
    c = F.col
    prompt, kind, source, answers, exemplar = c("prompt"), c("kind"), c("source"), c("answers"), c("exemplar")
    p, s = c("__normal.p"), c("__normal.s")
    fill, choice, short, claim = kind == "fill_blank", kind == "multiple_choice", kind == "short_answer", kind == "true_false"
    blanks = F.regexp_count(prompt, F.lit("(?U)" + BLANK))
    ids, texts = F.transform("options", lambda o: o["id"]), F.transform("options", lambda o: normal(o["text"]))
    chosen = F.try_element_at(F.filter("options", lambda o: o["id"] == c("correct_option_id")), F.lit(1))["text"]
    weights = F.aggregate(F.transform("rubric", lambda r: r["weight"]), F.lit(0.0), lambda a, w: a + w)
    described = F.array_join(F.transform("rubric", lambda r: r["description"]), " ")
    relatives = reduce(lambda a, b: a | b, (F.contains(prompt, F.lit(k)) & ~F.contains(s, F.lit(v)) for k, v in FAMILY.items()))
    distinct = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    checks = [
        (has(prompt, OCR_GARBAGE), "unreadable_ocr_prompt"),
        (about_metadata(p), "non_learning_question"),
        (has(p, QUANTITY_ASKED) & ~has(p, QUANTITY_CONFIRMED) & has(p, QUANTITY_QUOTED), "quantity_confirmation_mismatch"),
        (has(p, VISUAL) | has(prompt, POINTING), "unsupported_visual_claim"),
        (has(prompt, PAGE_REFERENCE), "unverified_page_reference"),
        (claim & ~is_claim(prompt), "invalid_true_false_statement"),
        (~fill & (blanks > 0), "unexpected_blank_placeholder"),
        (fill & (blanks == 0), "missing_blank_placeholder"),
        (fill & (blanks != 1), "multiple_blank_placeholders"),
        (fill & has(p, *OPEN_FILL), "open_ended_fill_prompt"),
        (fill & unreadable_cloze(prompt), "unreadable_cloze_context"),
        (pairs_quotes(prompt, p), "unsupported_dialogue_pairing"),
        (~F.array_contains("types", kind), "type_mismatch"),
        ((c("language") != c("asked_language")) | (c("difficulty") != c("asked_difficulty")), "request_mismatch"),
        ((F.size("citations") == 0) | ~distinct(c("citations")) | (c("n_known") < F.size("citations")), "invalid_citations"),
        (F.trim(source) == "", "insufficient_evidence"),
        (has(prompt, PRONOUN) & relatives, "unsupported_coreference"),
        (claim & c("english") & ~has(prompt, "[A-Za-z]{2,}"), "non_learning_question"),
        (has(p, THIS_THAT) & ((has(p, NEAR) & ~has(s, NEAR)) | (has(p, FAR) & ~has(s, FAR))), "unsupported_spatial_claim"),
        (has(p, CHANTED) & ~has(source, DISTINCT), "unsupported_distinction_claim"),
        (repeated_question(prompt, s), "ambiguous_dialogue_answer"),
        (has(prompt, INJURY_ASKED) & ~has(source, INJURY), "unsupported_scenario"),
        (choice & (~distinct(ids) | ~distinct(texts) | several_pointed(prompt, c("options"), s)), "ambiguous_options"),
        (choice & chosen.isNull(), "invalid_answer"),
        (choice & bare_introduction(p, chosen), "incomplete_expression"),
        (choice & mismatched_reply(p, chosen), "dialogue_answer_mismatch"),
        (choice & misattributed(prompt, chosen, source), "unsupported_speaker_attribution"),
        (choice & (other_named_reply(prompt, chosen, source) | lacks_question_back(p, chosen)), "dialogue_answer_mismatch"),
        (choice & ~contains_answer(s, chosen), "unsupported_answer"),
        (choice & contains_answer(p, chosen), "answer_leakage"),
        (fill & unprinted_fill(prompt, answers, s), "unsupported_fill_phrase"),
        (fill & F.exists(answers, lambda a: mismatched_reply(p, a)), "dialogue_answer_mismatch"),
        (fill & F.exists(answers, lambda a: misattributed(prompt, a, source)), "unsupported_speaker_attribution"),
        (fill & F.exists(answers, lambda a: lacks_question_back(p, a)), "dialogue_answer_mismatch"),
        (fill & ~distinct(F.transform(answers, normal)), "ambiguous_answers"),
        (fill & F.exists(answers, lambda a: ~contains_answer(s, a)), "unsupported_answer"),
        (fill & F.exists(answers, lambda a: contains_answer(p, a)), "answer_leakage"),
        (short & bare_introduction(p, exemplar), "incomplete_expression"),
        (short & misattributed(prompt, exemplar, source), "unsupported_speaker_attribution"),
        (short & (other_named_reply(prompt, exemplar, source) | lacks_question_back(p, exemplar)), "dialogue_answer_mismatch"),
        (short & (F.abs(weights - 1) > 0.001), "invalid_rubric"),
        (short & unlisted_terms(p, exemplar, described, s), "unsupported_answer"),
        (short & ~F.arrays_overlap(keywords(normal(exemplar)), keywords(s)), "unsupported_answer"),
        (short & contains_answer(p, exemplar), "answer_leakage"),
        (claim & ~F.arrays_overlap(keywords(normal(F.concat_ws(" ", prompt, c("rationale")))), keywords(s)), "unsupported_answer"),
    ]
    return F.coalesce(*(F.when(failed, code) for failed, code in checks))


def unreadable_cloze(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("(?U)" + TURN)) > 1) | (F.regexp_count(text, F.lit("[.!?]")) > 3) | has(text, MERGED_TURN)


def batch_state(drafts: DataFrame, batch: str, asked: str) -> DataFrame:
    """(batch, state): count_mismatch, the first draft's reason, duplicate_question (an earlier prompt's fingerprint), or valid.

    drafts have ``place`` in their batch and ``reason``.
    """
    same = Window.partitionBy(batch, "__f").orderBy("place")
    marked = drafts.withColumn("__f", question_fingerprint(F.col("prompt"))).withColumn("__n", F.row_number().over(same))
    failed = F.coalesce(F.col("reason"), F.when(F.col("__n") > 1, "duplicate_question"))
    per = marked.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked"), F.min(F.when(failed.isNotNull(), F.struct("place", failed.alias("f"))))["f"].alias("f"))
    return per.select(batch, F.when(F.col("n") != F.col("asked"), "count_mismatch").otherwise(F.coalesce("f", F.lit("valid"))).alias("state"))


def repair_grounding(drafts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(draft_id, citations): for each answer the first supplied chunk that has it, where the cited ones don't hold all.

    drafts (draft_id, job_id, citations, answers) and chunks (job_id, place, chunk_id, text) of the same inference call;
    a draft is compared with its own call's chunks only. Where an answer is in none of them, citations stay.

    Texts move once and are neither sorted nor kept: they stream past a hash table of their calls' answers, and what
    goes on is whether they hold them.
    """
    c = F.col
    each = drafts.select("job_id", "draft_id", "citations", F.posexplode("answers").alias("nth", "answer")).withColumn("answer", normal(c("answer")))
    texts = chunks.select("job_id", "place", "chunk_id", normal(c("text")).alias("__t"))
    holds = (F.length("answer") >= 2) & F.contains("__t", "answer")
    met = each.hint("shuffle_hash").join(texts, "job_id").select("job_id", "draft_id", "nth", "place", "chunk_id", F.array_contains("citations", c("chunk_id")).alias("cited"), holds.alias("holds"))
    first = F.min(F.when(c("holds"), F.struct("place", "chunk_id")))["chunk_id"]
    per = met.groupBy("job_id", "draft_id", "nth").agg(F.bool_or(c("holds") & c("cited")).alias("held"), first.alias("first"), F.size(F.collect_set(F.when(c("cited"), c("chunk_id")))).alias("known"))
    found_ = per.groupBy("job_id", "draft_id").agg(F.bool_and("held").alias("held"), F.array_sort(F.collect_list(F.struct("nth", "first"))).alias("fs"), F.bool_and(c("first").isNotNull()).alias("all"), F.max("known").alias("known"))
    joined = drafts.select("job_id", "draft_id", "citations").join(found_, ["job_id", "draft_id"], "left")
    good = c("held") & (c("known") == F.size(F.array_distinct("citations")))
    repaired = F.array_distinct(F.transform("fs", lambda f: f["first"]))
    return joined.select("draft_id", F.when(F.coalesce(~good & c("all"), F.lit(False)), repaired).otherwise(c("citations")).alias("citations"))


def rescale(rubric: Column) -> Column:
    """Rubric weights over their sum, where that is positive and not 1."""
    total = F.aggregate(F.transform(rubric, lambda r: r["weight"]), F.lit(0.0), lambda a, w: a + w)
    scaled = F.transform(rubric, lambda r: F.struct(r["description"].alias("description"), (r["weight"] / total).alias("weight")))
    return F.when((total > 0) & ~F.isnan(total) & (F.abs(total - 1) > 0.001), scaled).otherwise(rubric)
