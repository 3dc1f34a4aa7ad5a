"""The queries of this subpackage, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.llm import cotraining, decontamination, divergence, minhash, mixing, ngram_join, quality_rules, secret_scan, sstable, suffix_dedup, token_counts, toxicity, turn_trie
from chalkline.sources.tables import table


#: The public tokenizer of the queries, by name: workers find its file where they run.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The installed file of a public tokenizer on this machine."""
    return sstable.tokenizer_file(name)


def op1_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), ["doc_id"], TOKENIZER)


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sstable.token_tables(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    model, features = cotraining.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    score = F.col("score")
    return cotraining.score(features, model).select("doc_id", held_out, "text_score", "meta_score", "score", (score >= 0.5).cast("int").alias("predicted"), (score >= 0.5).alias("kept"))


def op4_char_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, ["doc_id"], model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, listed(F.col("spans")).alias("spans"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    counts = [F.col("rules")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return turn_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_word_pieces": op1_word_pieces,
    "op2_source_mixture": op2_source_mixture,
    "op3_cotraining": op3_cotraining,
    "op4_char_nbsvm": op4_char_nbsvm,
    "op5_token_tables": op5_token_tables,
    "op6_winnowing": op6_winnowing,
    "op7_markov_secrets": op7_markov_secrets,
    "op8_bottom_k": op8_bottom_k,
    "op9_deep_shallow": op9_deep_shallow,
    "op10_host_rules": op10_host_rules,
    "op11_turn_trie": op11_turn_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_ngram_join": op13_ngram_join,
}

_LIST_OF_WEIGHTS = ", ".join(map(str, mixing.WEIGHTS))

#: The mixture in SQL: water filling over sorted sources, shuffled streams, and the golden-ratio schedule of blocks.
_MIXTURE = f"""WITH RECURSIVE sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
weighted AS (SELECT *, ([{_LIST_OF_WEIGHTS}])[(sid - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, 2 * source_size AS cap FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted WINDOW o AS (ORDER BY cap / weight, sid)),
level AS (SELECT max(level) AS level FROM levels WHERE level < cap / weight),
targets AS (SELECT source, source_size, sid, least(cap::DOUBLE, coalesce(l.level * weight, cap)) AS target, ceil(round(least(cap::DOUBLE, coalesce(l.level * weight, cap))) / {mixing.BLOCK_WORDS})::BIGINT AS blocks FROM weighted, level l),
bounds AS (SELECT sid, blocks, sum(blocks) OVER (ORDER BY sid)::BIGINT - blocks AS lo FROM targets),
total AS (SELECT sum(blocks)::BIGINT AS n FROM targets),
fib(b, f) AS (SELECT 1::BIGINT, 2::BIGINT UNION ALL SELECT f, b + f FROM fib, total WHERE f < n),
golden AS (SELECT max(f) AS f, arg_max(b, f) AS b FROM fib),
points AS (SELECT r.range AS slot, r.range * b % f AS x FROM golden, range((SELECT f FROM golden)) r),
slots AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM points JOIN bounds ON x >= lo AND x < lo + blocks),
placed AS (SELECT s.*, t.sid, source_size, target, coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY md5(concat_ws(':', 'mix', doc_id::VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS row FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, e * source_size + start AS a, least(e * source_size + start + size, round(target)::BIGINT) AS z FROM placed, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
parts AS (SELECT row, sid, unnest(range(a // {mixing.BLOCK_WORDS}, (z - 1) // {mixing.BLOCK_WORDS} + 1)) AS block, a, z FROM epochs WHERE z > a),
taken AS (SELECT row, sum(least((block + 1) * {mixing.BLOCK_WORDS}, z) - greatest(block * {mixing.BLOCK_WORDS}, a))::BIGINT AS taken, min(slot) AS first_slot FROM parts JOIN slots USING (sid, block) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM placed LEFT JOIN taken USING (row)"""

_LIMITS = quality_rules.HostRules()
_RULES = ("short", "repeats", "symbols", "dup_lines")
_FAILS = "[" + ", ".join(f"n_{k}" for k in _RULES) + "]"

#: The rules and the hosts' posterior rates in SQL.
_HOST_RULES = f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT row, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t)),
g AS (SELECT row, i, w, lead(w, 4) OVER o IS NOT NULL AS whole, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS gram FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
r AS (SELECT row, i, w, whole AND count(*) FILTER (whole) OVER (PARTITION BY row, gram) > 1 AS often FROM g),
h AS (SELECT row, length(w) AS n, bool_or(often) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r),
words AS (SELECT row, count(*) AS n_words, sum(n)::BIGINT AS word_chars, count_if(hit)::BIGINT AS n_repeat_words FROM h GROUP BY row),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
m AS (SELECT doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN words USING (row) LEFT JOIN dup USING (row)),
f AS (SELECT *, n_words < {_LIMITS.min_words} AS short, 100 * n_repeat_words > {_LIMITS.max_repeat_pct} * n_words AS repeats, n_symbols > {_LIMITS.max_symbols_per_char}::DOUBLE * word_chars AS symbols, n_dup_lines > {_LIMITS.max_dup_line_share}::DOUBLE * n_lines AS dup_lines FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {", ".join(f"count_if({k})::DOUBLE AS n_{k}" for k in _RULES)} FROM f GROUP BY source),
each AS (SELECT source, n, unnest({_FAILS}) AS k, unnest(range({len(_RULES)})) AS rule FROM hosts),
sums AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(n * n) AS nn, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk FROM each GROUP BY rule),
rho AS (SELECT rule, mean, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n > h - 1 THEN ((kk - n * mean * mean) / (mean * (1 - mean)) - (h - 1)) / (n - nn / n - (h - 1)) ELSE 0 END AS rho FROM sums),
prior AS (SELECT rule, mean, CASE WHEN rho <= 1.0::DOUBLE / (1 + {_LIMITS.prior_strength[1]}::DOUBLE) THEN {_LIMITS.prior_strength[1]}::DOUBLE ELSE greatest({_LIMITS.prior_strength[0]}::DOUBLE, 1 / rho - 1) END AS strength FROM rho),
post AS (SELECT source, n + strength + 1 AS total, (k + mean * strength) / (n + strength) AS p, greatest({_LIMITS.max_host_rate}::DOUBLE, mean + {_LIMITS.above_prior}::DOUBLE) AS most FROM each JOIN prior USING (rule)),
verdicts AS (SELECT source, bool_and(p - {_LIMITS.certainty}::DOUBLE * sqrt(p * (1 - p) / total) <= most) AS ok FROM post GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND ok AS kept FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WINDOW = decontamination.WINDOW

#: Windows of all lengths that items have, joined as texts.
_WINDOWS = f"""WITH b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
l AS (SELECT item_id, w, least({_WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0), i AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM l), win AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM i),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n), g AS (SELECT row, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM p),
hit AS (SELECT DISTINCT row, g.n, pos, item_id FROM g JOIN win ON g.n = win.n AND g.gram = win.gram), c AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(pos, pos + n)) AS word FROM hit) GROUP BY row),
f AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (row) LEFT JOIN f USING (row)"""



def _near(shingle: int, least: int, columns: str) -> str:
    """All pairs that share a shingle, counted on whole sets, and what is reachable."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle} - 1], ' ')) END AS gs FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, unnest(gs) AS v FROM g), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, {columns} FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON a = d.doc_id"""


_COMPONENT = "coalesce(component, d.doc_id) AS component_id"
_NEAR = _near(minhash.SHINGLE, minhash.LEAST, f"{_COMPONENT}, coalesce(component, d.doc_id) = d.doc_id AS kept")
_SIMILAR = _near(ngram_join.SHINGLE, ngram_join.LEAST, _COMPONENT)

_BYTES = suffix_dedup.LENGTH

#: Every string of LENGTH bytes (by a 64-bit hash) with the smallest document that has it.
_REPEATS = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT row, doc_id, unnest(list_transform(range(0, n - {_BYTES} + 1), lambda i: hash(array_slice(b, i + 1, i + {_BYTES})))) AS k, unnest(range(0, n - {_BYTES} + 1)) AS i FROM d WHERE n >= {_BYTES}),
f AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)), s AS (SELECT row, i FROM p JOIN f USING (k) WHERE least < doc_id), r AS (SELECT row, i, coalesce(i > lag(i) OVER (PARTITION BY row ORDER BY i) + {_BYTES}, true) AS new FROM s),
k AS (SELECT row, i, sum(new::INT) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r), u AS (SELECT row, min(i) AS a, max(i) + {_BYTES} AS z FROM k GROUP BY row, run),
x AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS y FROM u), t AS (SELECT row, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(CASE WHEN a > y THEN hex(array_slice(b, y + 1, a)) ELSE '' END, '' ORDER BY a) AS head FROM x JOIN d USING (row) GROUP BY row)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || CASE WHEN coalesce(last, 0) < n THEN hex(array_slice(b, coalesce(last, 0) + 1, n)) ELSE '' END)) AS kept_sha256 FROM d LEFT JOIN t USING (row)"""

#: Nodes by lists of turn numbers; crc32 from its table of 256 entries.
_TRIE = f"""WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
bits(i, x, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, xor(x >> 1, (x & 1) * 3988292384), k + 1 FROM bits WHERE k < 8), crc AS (SELECT list(x ORDER BY i) AS tab FROM bits WHERE k = 8),
h AS (SELECT c, c - c % {turn_trie.FAMILY} AS b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {turn_trie.OPENINGS} AS h FROM (SELECT DISTINCT c FROM t), crc),
r AS (SELECT h.c, 0 AS part, t.i, id, n FROM h JOIN t ON t.c = b WHERE t.i <= h UNION ALL SELECT h.c, 1, t.i, id, n FROM h JOIN t ON t.c = h.c WHERE t.i > h),
s AS (SELECT h.c, coalesce(list(id ORDER BY part, i) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(n ORDER BY part, i) FILTER (id IS NOT NULL), []) AS ns FROM h LEFT JOIN r USING (c) GROUP BY h.c),
p AS (SELECT c, ids, ns, unnest(range(0, len(ids) + 1)) AS d FROM s), g AS (SELECT ids[1:d] AS pre, d, min(c) AS c, count(*) AS n, any_value(CASE WHEN d > 0 THEN ns[d] ELSE 0 END) AS len, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ids) = d), '') AS ends FROM p GROUP BY ALL),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS k FROM g WHERE d > 0 GROUP BY ALL), f AS (SELECT g.*, coalesce(k, 0) AS k FROM g LEFT JOIN k USING (pre)),
u AS (SELECT pre[1:e] AS pre, (k = 0)::INT AS leaf, (n - 1) * len AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f)), v AS (SELECT pre, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM u GROUP BY pre)
SELECT f.c AS conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN up.c END AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN v USING (pre) LEFT JOIN g up ON f.d > 0 AND up.pre = f.pre[1:f.d - 1]"""

_SCALE = f"{divergence.SCALE}::HUGEINT"

#: Every kept term with every source of its language, and the pairs of these.
_DIVERGENCE = f"""WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("text")} AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM t),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, sum(c)::BIGINT AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS k, (1 + {_SCALE} * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + v))::HUGEINT AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
q AS (SELECT lang, term, (1 + {_SCALE} * (c + 1) // (n + v))::HUGEINT AS q FROM kept JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE k > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= {divergence.TOP}"""

ORACLE_SQL: dict[str, str] = {"op2_source_mixture": _MIXTURE, "op6_winnowing": _WINDOWS, "op8_bottom_k": _NEAR, "op9_deep_shallow": _REPEATS, "op10_host_rules": _HOST_RULES, "op11_turn_trie": _TRIE, "op12_source_divergence": _DIVERGENCE, "op13_ngram_join": _SIMILAR}
