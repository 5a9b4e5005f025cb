"""Registered queries of the subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.llm import bpe, chat, decontaminate, filter_audit, hyperminhash, langid, lm_scoring, passages, quality, simhash, token_file, turn_repair, warc
from tapewire.llm.batches import null_safe
from tapewire.operators.scale import checkpointed

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, "base_failed", "kept")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "spans",
    )


def crc_mod(doc_id: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.profiles(docs.where(crc_mod("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


SQL["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
 d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id,
   array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
     (CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS INTEGER), 1)), '') AS b32
  FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.expand(talks))
    line = F.transform(F.max("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return read.groupBy("conv_id").agg(
        F.size(F.max("turns")).cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )


SQL["op3_chat_format"] = r"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 size AS (SELECT *, length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))
   + length(regexp_extract_all(text, '<\\*\|(im_start|im_end|endoftext)\|>|<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS chars FROM talks),
 upto AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
   turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM size)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(prefix) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id"""


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    done = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = passages.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "__cut.n_units", "__cut.n_removed", (F.col("__cut.n_removed") > 0).alias("removed"), "__cut.spans", "text")


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return token_file.write_and_read(table(spark, sf_dir, "documents"), tokenizer, vocabulary=49_408, end=2)


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scoring.score(docs, docs.where(crc_mod("doc_id", 5) != 1))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
 l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, good, toxic,
   CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
   + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
   + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
   + CASE WHEN first_id < w.doc_id THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 letters AS (SELECT substr('ABCDE', i + 1, 1) AS letter, 1 << i AS bit FROM (SELECT CAST(unnest(range(5)) AS INT) AS i)),
 walk(filter_order, applied) AS (
   SELECT '', 0 UNION ALL SELECT filter_order || letter, applied | bit FROM walk JOIN letters ON applied & bit = 0),
 orders AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM walk WHERE length(filter_order) = 5),
 steps AS (SELECT o.filter_order, step, letter, bit, w.applied FROM orders o JOIN letters ON letter = substr(o.filter_order, step, 1)
   JOIN walk w ON w.filter_order = left(o.filter_order, step - 1)),
 cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m GROUP BY 1, 2),
 r AS (SELECT part, filter_order, step, letter,
   coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS kept,
   coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS removed,
   coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0) AS redundant,
   coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
   coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS good_lost,
   coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""


@query
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    beside = checkpointed(simhash.beside_edited(table(spark, sf_dir, "documents")))
    return simhash.with_links(beside)


def damaged(talks: DataFrame) -> DataFrame:
    """The turns with faults put in: by a hash of conversation and turn a row is dropped, emptied, cut off, repeated or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), copies.alias("copy")).drop("copy")


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    counts = turn_repair.summarise(turn_repair.repair(damaged(talks)), ordered=True)
    every = null_safe(talks.select("conv_id").distinct(), counts, ["conv_id"], "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.select("conv_id", *[F.coalesce(c, empty.get(c, F.lit(0))).alias(c) for c in counts.columns if c != "conv_id"])


# ``vec`` holds the cost vectors behind each row, from the last row to the first; ``walk`` takes one letter a level.
SQL["op12_turn_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
   list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations),
 hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
   list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM keyed),
 damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i,
   count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
 flagged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
   CASE WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 1 END AS cut, left(role, 1) AS c,
   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
 turns AS (SELECT *, blank OR again AS must FROM flagged),
 vec(conv_id, i, v) AS (
  SELECT conv_id, n, [0, 4, 2, 0] FROM turns WHERE i = n
  UNION ALL
  SELECT conv_id, i, [least(c0, 2 + c2, 4 + c3), least(c1, 2 + c2, 4 + c3), least(c2, 2 + c3), least(c3, 2 + c2)] FROM (
   SELECT t.conv_id, t.i - 1 AS i,
    least(3 + v[1], CASE WHEN must THEN 99999999 ELSE 2 + cut + v[3] END, CASE WHEN must OR c NOT IN ('s', 'u') THEN 99999999 WHEN c = 's' THEN cut + v[2] ELSE cut + v[3] END) AS c0,
    least(3 + v[2], CASE WHEN must THEN 99999999 ELSE 2 + cut + v[3] END, CASE WHEN must OR c <> 'u' THEN 99999999 ELSE cut + v[3] END) AS c1,
    least(3 + v[3], CASE WHEN must THEN 99999999 ELSE 2 + cut + v[4] END, CASE WHEN must OR c <> 'a' THEN 99999999 ELSE cut + v[4] END) AS c2,
    least(3 + v[4], CASE WHEN must THEN 99999999 ELSE 2 + cut + v[3] END, CASE WHEN must OR c <> 'u' THEN 99999999 ELSE cut + v[3] END) AS c3
   FROM vec JOIN turns t ON t.conv_id = vec.conv_id AND t.i = vec.i)),
 walk(conv_id, i, st, audit, said) AS (
  SELECT conv_id, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM turns WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN st WHEN 'K' THEN keep ELSE nxt END, audit || letter,
   CASE letter WHEN 'D' THEN said WHEN 'I' THEN list_append(said, CASE nxt WHEN 3 THEN 'user:' ELSE 'assistant:' END)
    WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE nxt WHEN 3 THEN 'user:' ELSE 'assistant:' END || text) END
  FROM (SELECT *, CASE WHEN here[st] = 3 + after[st] THEN 'D' WHEN here[st] = 2 + here[nxt] THEN 'I'
     WHEN NOT must AND keep > 0 AND here[st] = cut + after[keep] THEN 'K' ELSE 'R' END AS letter
    FROM (SELECT w.conv_id, w.i, w.st, w.audit, w.said, h.v AS here, a.v AS after, t.must, t.cut, t.role, t.text,
       CASE w.st WHEN 3 THEN 4 ELSE 3 END AS nxt,
       CASE WHEN t.c = 's' AND w.st = 1 THEN 2 WHEN t.c = 'u' AND w.st <> 3 THEN 3 WHEN t.c = 'a' AND w.st = 3 THEN 4 ELSE 0 END AS keep
      FROM walk w JOIN vec h ON h.conv_id = w.conv_id AND h.i = w.i - 1
       LEFT JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i
       LEFT JOIN vec a ON a.conv_id = w.conv_id AND a.i = w.i
      WHERE h.v[w.st] > 0 OR t.i IS NOT NULL))),
 done AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said FROM walk GROUP BY conv_id),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
   count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut = 1 AND NOT must) AS truncated,
   count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost,
 coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id = e.conv_id
 LEFT JOIN done d ON d.conv_id = e.conv_id LEFT JOIN vec ON vec.conv_id = e.conv_id AND vec.i = 0"""
