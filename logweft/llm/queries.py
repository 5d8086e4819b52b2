"""One query for each text operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, fingerprint, langid, licenses, linededup, merkle, neardup, pii, repair, secret_scan, unigram
from .common import group_key, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def digest(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def _count_of(spans: str, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_report(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", digest(F.col("kept_text")).alias("kept_sha256"))


SQL["op3_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY doc_id
"""


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    base = pii.listed(F.filter("spans", lambda s: s["kind"].isin(pii.BASE)))
    counts = [_count_of("spans", k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, digest(base).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = secret_scan.language(docs)
    forest = secret_scan.train(secret_scan.labelled_findings(spark, vocabulary=known.words), pairs=known.pairs)
    found = secret_scan.find_secrets(docs, forest, path_col="source", pairs=known.pairs)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))


@query
def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprint.compare_edited(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op7_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    done = chat.format_conversations(rows.unionByName(more))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(every).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql() -> str:
    out = "replace(text, chr(92), chr(92) || 'e')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c.replace('<', '_' + 'l').replace('[', '_' + 'b')}')"  # as long as the real escapes
    return out


SQL["op8_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, CASE WHEN {" OR ".join(f"contains(text, '{c}')" for c in chat.CONTROLS)} OR {" OR ".join(f"contains(text, chr(92) || '{x}')" for x in "elbg")} THEN {_escaped_sql()} ELSE text END AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(body) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(role) + 18 END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = unigram.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return unigram.count_tokens(read(spark, sf_dir, "documents"), vocab)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


#: crc32 of a text in ASCII, which DuckDB lacks: a table of 256 numbers, and one step for each character.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS t"


def _crc_sql(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*fields)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = merkle.leaf_of(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields))
    leaves = docs.select("doc_id", "source", merkle.leaf_of(*map(F.col, fields)).alias("leaf"), F.when(changed, tampered).alias("tampered"))
    done = merkle.manifest(leaves, F.col("source"), ["doc_id"], ["doc_id", "tampered"]).rows
    done = done.withColumn("folded", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    proof = digest(merkle.proof_text(F.col("steps"))).alias("proof_sha256")
    return done.select("doc_id", *(merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), proof, merkle.hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    fields = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
l AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS bad FROM documents, crc),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM l),
tree AS (SELECT 0 AS lev, source, place, n, leaf AS d FROM leaves
 UNION ALL SELECT lev + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY lev, source, place // 3, n),
tops AS (SELECT source, d AS subroot, lev AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS lev, place, n, subroot AS d FROM tops
 UNION ALL SELECT lev + 1, place // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY lev, place // 3, n),
begin AS MATERIALIZED (SELECT row_number() OVER () AS r, l.*, subroot, height, t.place AS top, t.n AS tops, (SELECT d FROM upper WHERE n = 1) AS root FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source),
steps AS (SELECT r, lev, string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place < s.place // CAST(pow(3, lev) AS BIGINT)) AS l, string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place > s.place // CAST(pow(3, lev) AS BIGINT)) AS h
 FROM begin s JOIN tree b ON s.source IS NOT DISTINCT FROM b.source AND b.n > 1 AND b.place // 3 = s.place // CAST(pow(3, lev + 1) AS BIGINT) GROUP BY r, lev
 UNION ALL SELECT r, height + lev, string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place < top // CAST(pow(3, lev) AS BIGINT)), string_agg(b.d, '' ORDER BY b.place) FILTER (WHERE b.place > top // CAST(pow(3, lev) AS BIGINT))
 FROM begin s JOIN upper b ON b.n > 1 AND b.place // 3 = top // CAST(pow(3, lev + 1) AS BIGINT) GROUP BY r, height, lev),
folds AS (SELECT r, 0 AS lev, coalesce(bad, leaf) AS d FROM begin
 UNION ALL SELECT f.r, f.lev + 1, sha256(coalesce(l, '') || d || coalesce(h, '')) FROM folds f JOIN steps USING (r, lev)),
ends AS (SELECT r, max_by(d, lev) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(coalesce(l, '') || coalesce(h, ''), '' ORDER BY lev)) AS p FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM begin JOIN ends USING (r) LEFT JOIN proofs USING (r)
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: of twenty turns one is dropped, one emptied, one cut, one repeated and one given to the user, by the crc32 of ``conv_id:turn``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("fate", fate).where("fate <> 0")
    return left.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", group_key(F.col("conv_id")))
    found = every.join(done.report.drop("conv_id"), "conv", "left").join(repair.digests(done.turns), "conv", "left")
    counts = ("gaps", *repair.FAULTS, "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", digest(F.lit(""))).alias("repaired_sha256"))


#: One turn at a time over the four states, where the operator multiplies matrices in pieces.
SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, lag(role) OVER w AS prev FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
t AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS own FROM o),
move(own, src, dst) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(src, dst, cost, edits) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
edit AS MATERIALIZED (SELECT conv_id, i, src, dst, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS cost, 'K' AS e FROM t JOIN move USING (own) WHERE fault NOT IN ('blank', 'duplicate')
 UNION ALL SELECT conv_id, i, src, dst, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R' FROM t, move WHERE move.own <> 's' AND fault NOT IN ('blank', 'duplicate')
 UNION ALL SELECT conv_id, i, s.src, s.src, 4, 'D' FROM t, (VALUES (0), (1), (2), (3)) s(src)),
closed AS MATERIALIZED (SELECT conv_id, i, edit.src, ins.dst, min(struct_pack(cost := CAST(edit.cost + ins.cost AS BIGINT), audit := e || ins.edits)) AS m FROM edit JOIN ins ON edit.dst = ins.src GROUP BY ALL),
run AS (SELECT conv_id, 0::BIGINT AS i, ins.dst AS state, struct_pack(cost := CAST(cost AS BIGINT), audit := edits) AS v FROM (SELECT DISTINCT conv_id FROM t), ins WHERE src = 0
 UNION ALL SELECT run.conv_id, run.i + 1, dst, min(struct_pack(cost := v.cost + m.cost, audit := v.audit || m.audit)) FROM run JOIN closed c ON run.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = run.i + 1 AND c.src = run.state GROUP BY run.conv_id, run.i + 1, dst),
stat AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i > 1 AND left(prev, 1) || own NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
best AS (SELECT run.conv_id, min(v) AS v FROM run JOIN stat ON run.conv_id IS NOT DISTINCT FROM stat.conv_id AND run.i = n WHERE state IN (0, 3) GROUP BY run.conv_id),
e AS (SELECT conv_id, unnest(string_split(v.audit, '')) AS e, unnest(range(1, length(v.audit) + 1)) AS step, length(replace(v.audit, 'D', '')) % 2 AS odd FROM best WHERE v.audit <> ''),
p AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w - 1 AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
r AS (SELECT p.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS s FROM p LEFT JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.i = t.i WHERE e <> 'D' GROUP BY p.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat ON c.conv_id IS NOT DISTINCT FROM stat.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    base = F.transform(F.filter("spans", lambda s: s["phrase"]), lambda s: s["start"].cast("long"))
    names = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("spans", keep), lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        names(lambda s: s["phrase"]).alias("base_labels"), names(lambda s: F.lit(True)).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


def _templates_sql() -> str:
    rows = [(t, x.label, x.phrase, licenses.words_of(x.text)) for t, x in enumerate(licenses.PHRASES + licenses.NOTICES)]
    return ", ".join(f"({t}, '{label}', {phrase}, {words})" for t, label, phrase, words in rows)


SQL["op13_license_scan"] = rf"""
WITH tpl(t, label, phrase, tw) AS (VALUES {_templates_sql()}),
k AS (SELECT *, len(tw) AS size, CASE WHEN len(tw) >= {licenses.LONG} THEN {licenses.LONG} ELSE {licenses.SHORT} END AS k FROM tpl),
tg AS (SELECT t, label, phrase, size, k, i AS spot, array_to_string(tw[i + 1:i + k], ' ') AS g FROM (SELECT *, unnest(range(size - k + 1)) AS i FROM k)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT r, t, label, phrase, size, tg.k, spot, i - spot AS diag FROM dg JOIN tg ON dg.k = tg.k AND dg.g = tg.g),
ln AS (SELECT r, t, label, phrase, size, diag, diag + min(spot) AS b, diag + max(spot) + k AS e, list_distinct(flatten(list(range(spot, spot + k)))) AS cov FROM hit GROUP BY r, t, label, phrase, size, k, diag),
nw AS (SELECT *, CASE WHEN NOT phrase AND b <= max(e) OVER (PARTITION BY r, t ORDER BY b, diag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {licenses.GAP} AND abs(diag - lag(diag) OVER (PARTITION BY r, t ORDER BY b, diag)) <= {licenses.SHIFT} THEN 0 ELSE 1 END AS n FROM ln),
pl AS (SELECT *, sum(n) OVER (PARTITION BY r, t ORDER BY b, diag ROWS UNBOUNDED PRECEDING) AS place FROM nw),
sp AS (SELECT r, t, label, phrase, min(b) AS b, len(list_distinct(flatten(list(cov)))) / any_value(size) AS cover FROM pl GROUP BY r, t, label, phrase, place),
ok AS (SELECT * FROM sp WHERE cover >= CASE WHEN phrase THEN 1.0 ELSE {licenses.LEAST_COVER} END)
SELECT d.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (WHERE phrase) AS n_base, CAST(min(b) FILTER (WHERE phrase) AS BIGINT) AS first_word, CAST(max(b) FILTER (WHERE phrase) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0.0) AS score
FROM d LEFT JOIN ok USING (r) GROUP BY d.r, d.doc_id
"""
