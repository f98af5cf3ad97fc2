"""The registered queries of the corpus operators: each reads its whole table, and derives digests from the operator's output."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardpanel.llm import chat, language, lexical
from wardpanel.llm.bpe import encode_corpus
from wardpanel.llm.common import table
from wardpanel.llm.digest_index import DigestIndex, add_new
from wardpanel.llm.near_dedup import near_classes
from wardpanel.llm.packing import pack
from wardpanel.llm.periodic import periodic_runs, with_digests
from wardpanel.llm.pii import pseudonymise
from wardpanel.llm.posting_search import nearest
from wardpanel.llm.quality import add_score, held_out, train
from wardpanel.llm.substring_dedup import remove_repeated_words
from wardpanel.llm.suffix_dedup import remove_repeated_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """A vocabulary file; CORPUS_TOKENIZERS names another folder than that of the installed package."""
    folder = os.environ.get("CORPUS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pseudonym_key() -> str:
    return os.environ.get("CORPUS_PSEUDONYM_KEY", "a key for tests; set CORPUS_PSEUDONYM_KEY")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_suffix_dedup",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT r, unnest(range(1, length(h) // 2 - 398)) AS p FROM d WHERE length(h) >= 800),
    w AS (SELECT s.r, s.p, md5_number(substr(d.h, 2 * s.p - 1, 800)) AS m FROM s JOIN d ON s.r = d.r),
    again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
    hit AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM w WHERE m IN (SELECT m FROM again)),
    part AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM hit),
    span AS (SELECT r, min(p) AS a, max(p) + 399 AS b FROM part GROUP BY r, g),
    gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM span),
    cut AS (
        SELECT g.r, count(*) AS n, sum(b - a + 1) AS gone, max(b) AS last, string_agg(substr(d.h, 2 * e + 1, 2 * (a - 1 - e)), '' ORDER BY a) AS head
        FROM gap g JOIN d ON g.r = d.r GROUP BY g.r
    )
    SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(c.head, '') || substr(d.h, 2 * coalesce(c.last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN cut c ON d.r = c.r
    """,
)
def op1(spark, sf):
    out = remove_repeated_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op2_substring_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
    m AS (SELECT r, p, md5_number(array_to_string(w[p:p + 34], ' ')) AS m FROM s),
    again AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
    hit AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM m WHERE m IN (SELECT m FROM again)),
    word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN hit USING (r, i) GROUP BY r)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept k USING (r)
    """,
)
def op2(spark, sf):
    out = remove_repeated_words(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_posting_search")
def op3(spark, sf):
    return nearest(table(spark, sf, "embeddings"))


@query("op4_near_dedup")
def op4(spark, sf):
    return near_classes(table(spark, sf, "documents"))


@query("op5_packing")
def op5(spark, sf):
    out = pack(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op6_pseudonyms")
def op6(spark, sf):
    return pseudonymise(table(spark, sf, "documents"), pseudonym_key(), counts_col="n_replaced").select("doc_id", "text", "n_replaced")


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query(
    "op7_chat_format",
    f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
    ),
    e AS (SELECT *, replace(replace(t, chr(16), chr(16) || '0'), '<|', '<' || chr(16) || '|') AS te, replace(replace(replace(role, chr(16), chr(16) || '0'), '<|', '<' || chr(16) || '|'), chr(10), chr(16) || 'n') AS re FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
        CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(re) + length(te) + 24) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op7(spark, sf):
    """The whole table and conversation -1, through the layout of their schema and back from the formatted text."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.format_chats(chat.rows_to_structs(rows.unionByName(control)))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_mask"))
    read = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op8_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    scored = add_score(docs.select("doc_id", "text"), train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_byte_bpe")
def op9(spark, sf):
    out = encode_corpus(table(spark, sf, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), decoded_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op10_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op10(spark, sf):
    return add_new(table(spark, sf, "documents"), DigestIndex(spark))


@query(
    "op11_ranked_search",
    r"""
    WITH letters AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents, letters),
    s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
    m AS (SELECT r, doc_id, 50 + (50 * len(t) * s.n) // s.l AS m FROM d, s WHERE len(t) > 0),
    o AS (SELECT r, unnest(t) AS term FROM d),
    f AS (SELECT r, term, count(*) AS tf FROM o GROUP BY r, term),
    df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    i AS (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    a AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i, letters),
    w AS (SELECT a.q, a.item_id, a.term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM a JOIN df USING (term), s),
    c AS (
        SELECT w.q, w.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) AS BIGINT) AS score
        FROM w JOIN f USING (term) JOIN m USING (r) GROUP BY w.q, w.item_id, m.r, m.doc_id
    ),
    k AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
    """,
)
def op11(spark, sf):
    return lexical.search(lexical.build_index(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


@query("op12_language_id")
def op12(spark, sf):
    """Learned from the rows whose checksum leaves 1 to 4 when divided by 5; the prediction reads the text alone."""
    docs = table(spark, sf, "documents")
    out = language.add_language(docs.select("doc_id", "text"), language.train(docs))
    return out.select("doc_id", (F.coalesce(language.remainder(F.col("doc_id"), 5), F.lit(1)) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of a document whose id has a checksum divisible by ten, with a periodic tail; others, and those without an id, unchanged."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op13_periodic_runs")
def op13(spark, sf):
    out = with_digests(periodic_runs(table(spark, sf, "documents"), prepare=repeat_tail))
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
