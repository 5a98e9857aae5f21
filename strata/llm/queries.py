"""The registered queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import ann, bpe, chat, decontam, html_crf, jaccard, language, packing, periods, repeats, secrets, toxicity, variants
from strata.llm.common import id_fold, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs).select("doc_id", "spans", F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS)).alias("base"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, TOKENIZER, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_fold("doc_id", 3) == 1)
    model = language.fit(docs.filter(~F.col("held_out")).select("text", "lang"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_fold("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(id_fold("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    done = chat.read_back(chat.format_chats(rows))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learned = F.array_join("t.learned", "")
    return done.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                        F.col("chars").cast("long").alias("formatted_chars"))


def with_lost_letters(runs: DataFrame) -> DataFrame:
    """The contract's input: a run whose crc32 with its document's id is a multiple of 31 loses one letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int") + 1
    return runs.select(F.when(h % 31 == 0, F.overlay("word", F.lit(""), at, F.lit(1))).otherwise(F.col("word")).alias("word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.letter_runs(table(spark, sf_dir, "documents"))  # a run only loses letters, so shorter ones don't matter
    return variants.group(variants.count_words(with_lost_letters(runs)))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def with_cycles(docs: DataFrame) -> DataFrame:
    """The contract's input: in documents whose crc32 of the id is a multiple of 10 the words from
    number ``a`` on go round the first ``p`` of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.greatest(F.size(words), F.lit(1)), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    cycled = F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a))
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.runs(with_cycles(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"),
                         F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("b.less"), F.col("b.period")
    return found.select("doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _secrets_sql() -> str:
    def spans(rank: int, r: secrets.Rule) -> str:
        p = "'" + r.pattern.replace("'", "''") + "'"
        return f"""SELECT n, {rank} AS rank, '{r.kind}' AS kind,
            list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS l
            FROM (SELECT n, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM
                  (SELECT n, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, string_split_regex(t, {p}) AS p FROM d))
            WHERE length(g[i]) >= {r.least}"""

    each = " UNION ALL ".join(spans(i, r) for i, r in enumerate(secrets.RULES))
    one = "kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT"
    base = f"rank < {len(secrets.BASE_KINDS)}"
    return f"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({each}),
        a AS (SELECT n, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE_KINDS))},
              string_agg({one}, ',' ORDER BY s, rank) FILTER ({base}) AS b, string_agg({one}, ',' ORDER BY s, rank) AS sp FROM s GROUP BY n)
        SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE_KINDS)},
               sha256(coalesce(b, '')) AS base_sha256, coalesce(sp, '') AS spans FROM d LEFT JOIN a USING (n)"""


def _chat_sql() -> str:
    def esc(x: str) -> str:
        return rf"regexp_replace(regexp_replace(replace({x}, '\', '\\'), '(<)(\||/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')"

    marks = len(chat.TURN + chat.SAYS + chat.END)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*)::BIGINT AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum(length({esc('role')}) + length({esc('text')}) + {marks})::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id"""


def _crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, byte by byte with the usual table of the reflected polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    raw = f"hex({text})"
    byte = f"list_transform(range(len({raw}) // 2), lambda i: ('0x' || substr({raw}, 2 * i + 1, 2))::BIGINT)"
    step = f"xor(c >> 8, ({table}::BIGINT[])[xor(c, b) % 256 + 1])"
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, {byte}), lambda c, b: {step}), {0xFFFFFFFF}::BIGINT)"


def _variants_sql() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{variants.RUN}+')), '{upper}', '{lower}') AS run FROM documents),
        o AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {variants.MIN_LENGTH} GROUP BY ALL),
        h AS MATERIALIZED (SELECT run, n, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM o),
        w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
              WHERE length(word) >= {variants.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {variants.MIN_COUNT}),
        d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        p AS MATERIALIZED (SELECT d.word AS a, w.word AS b FROM d JOIN w ON w.word = d.less
              UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.less
              UNION SELECT x.word, y.word FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
        b AS (SELECT p.a AS word, count(*)::BIGINT AS n_near, arg_min(p.b, struct_pack(n := -w.n, b := p.b)) AS best, max(w.n) AS best_n FROM p JOIN w ON w.word = p.b GROUP BY p.a),
        f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {variants.FORM_FACTOR} * w.n THEN best END AS form,
              CASE WHEN best_n >= {variants.FORM_FACTOR} * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
        t(word, root, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, x.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM t GROUP BY word) x USING (word)"""


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_extract, op3_best_fit_packing, op4_language_id, op5_ngram_jaccard_join, op6_decontamination, op7_toxicity, op8_ann_search, op9_suffix_dedup, op10_chat_format, op11_spelling_variants, op12_bpe_round_trip, op13_periodic_runs)}
ORACLES = {"op1_secret_scan": _secrets_sql(), "op10_chat_format": _chat_sql(), "op11_spelling_variants": _variants_sql()}
