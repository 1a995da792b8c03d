"""The queries of this subpackage, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, decontaminate, jaccard_join, language_id, leaderboard, line_crf, mixing, packing, periodic_runs, quality_rules, sharding, suffix_dedup, tokens
from ._shared import crc32_sql, held_out, learnable, let, words

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TABLE = 65537


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(learnable(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_id.predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS, TABLE)


def op2_sql() -> str:
    digits = "".join(f"{s:02d}" for s in sharding.shard_table(SHARDS, TABLE))
    return f"""
        WITH placed AS (
            SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce('v' || CAST(doc_id AS VARCHAR), 'n')), 1, 15) AS BIGINT) % {TABLE} AS INTEGER) AS slot
            FROM documents
        )
        SELECT doc_id, slot, CAST(substr('{digits}', 2 * slot + 1, 2) AS INTEGER) AS shard FROM placed
    """


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.clean(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_words")


def op7_sql() -> str:
    return r"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ),
        spread AS (
            SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs
        ),
        joined AS (
            SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS gram
            FROM spread WINDOW p AS (PARTITION BY rid ORDER BY i)
        ),
        windows AS (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM joined WHERE gram IS NOT NULL
        ),
        repeated AS (
            SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
            FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM windows WHERE n > 1) GROUP BY rid
        ),
        lines AS (
            SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
        ),
        judged AS (
            SELECT rid, line, n,
                   NOT regexp_matches(line, '[.!?:;…。！？][\"''\)\]»”’]*[\x20\x09-\x0D]*$')
                   OR len(regexp_extract_all(line, '[!?#*$%&<>=~^]{2,}')) * 4 >= n
                   OR (len(regexp_extract_all(line, '[|»›•]')) >= 2 AND len(regexp_extract_all(line, '[|»›•]')) * 3 >= n)
                   OR regexp_matches(line, '(?i)licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|enable javascript|click here|sign up for our|subscribe to our|©|copyright \(c\)|spdx-license-identifier') AS bad
            FROM lines WHERE n > 0
        ),
        by_doc AS (
            SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                   count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(n) FILTER (bad), 0) AS lost_words
            FROM judged GROUP BY rid
        ),
        counted AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                   CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                   CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
                   CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
                   CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
            FROM docs LEFT JOIN by_doc USING (rid) LEFT JOIN repeated USING (rid)
        )
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_words <= 0.5 * n_words AS kept
        FROM counted
    """


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.documents.select("doc_id", "size", "source_size", "target", "taken")


def vocabulary() -> str:
    """The path of the production vocabulary, as the tokenizers' package gives it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_sql() -> str:
    return """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
            FROM vectors q JOIN vectors d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5
    """


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), vocabulary(), 4096, end_id=1)
    slim = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(slim, 4096, ["doc_id", "piece", "ids_crc32"])


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tokens.write_ids(_table(spark, sf_dir, "documents"), vocabulary(), "token-ids", end_id=2)
    return tokens.read_ids(table).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def quality_model(docs: DataFrame, labels: DataFrame) -> line_crf.LineCRF:
    """The classifier learnt from the labelled documents that are not held out."""
    return line_crf.learn(docs, labels.where(learnable(F.col("doc_id"))))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_model(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), line_crf.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def op11_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
        bench AS (SELECT CAST(item_id AS VARCHAR) AS item_id, ws, least(10, len(ws)) AS size FROM (SELECT item_id, {words} AS ws FROM benchmark) WHERE len(ws) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[i + 1 : i + size], ' ') AS win FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS i FROM bench)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT rid, size, i, array_to_string(ws[i + 1 : i + size], ' ') AS win FROM (SELECT *, unnest(range(len(ws) - size + 1)) AS i FROM docs, sizes WHERE len(ws) >= size)),
        hits AS (SELECT rid, i, size, item_id FROM places JOIN windows USING (size, win)),
        hit_words AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM hits) GROUP BY rid),
        ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN ids USING (rid)
    """


#: Items of one shard of a board at most, about.
SHARD_ITEMS = 20_000


def sale_line_amounts(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """board, item, day, arrival, amount and batch of every sale line; board or item are null where a line is ignored."""
    key = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    rows = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at", F.crc32(key.cast("binary")).alias("h"))
    day = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), 19723 + F.col("h") % 150)
    rows = rows.select("item_id", "vendor_id", "quantity", "amount", (F.col("flag") == "swapped").alias("swapped"), "h", day.alias("day"))
    rows = rows.withColumn("arrival", F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).drop("h")
    rows = leaderboard.with_looked_up(rows, vendors, "vendor_id", {"nation_id": "min(nation_id)"}).drop("vendor_id", "found")
    rows = leaderboard.with_looked_up(rows, items, "item_id", {"price": "max(price)"})
    cents = lambda x: F.floor(100 * x + 0.5).cast("double")
    paid = F.coalesce(cents(F.col("amount")), F.col("quantity") * cents(F.col("price")), F.lit(0.0))
    batch = F.least(F.lit(10), 1 + F.floor((F.col("arrival") - 19723) * 10 / 180))
    return rows.select(F.col("nation_id").alias("board"), F.when(F.col("found"), F.col("item_id")).alias("item"), "day", "arrival", F.when(F.coalesce("swapped", F.lit(False)), -paid).otherwise(paid).alias("amount"), batch.cast("int").alias("batch"))


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "items")
    lines = sale_line_amounts(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "vendors"), items)
    feed = leaderboard.change_feed(lines, shards=max(16, -(-items.count() // SHARD_ITEMS)))
    return feed.select(F.col("board").alias("nation_id"), F.col("arrival").alias("arrival_day"), F.col("item").alias("item_id"), "batch", "change", "old_rank", "new_rank", F.col("amount").cast("long").alias("revenue"))


def op12_sql() -> str:
    key = "concat_ws(',', coalesce(CAST(sale_id AS VARCHAR), ''), coalesce(CAST(item_id AS VARCHAR), ''), coalesce(CAST(vendor_id AS VARCHAR), ''), coalesce(CAST(line_no AS VARCHAR), ''))"
    return f"""
        WITH hashed AS (SELECT *, {crc32_sql("k")} AS h FROM (SELECT *, {key} AS k FROM sale_lines)),
        dated AS (SELECT *, coalesce(CAST(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS BIGINT), 19723 + h % 150) AS s FROM hashed),
        arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
        cut AS (SELECT *, least(10, 1 + CAST(floor((a - 19723) * 10 / 180) AS BIGINT)) AS batch FROM arrived),
        latest AS (SELECT batch, max(s) AS top FROM cut GROUP BY batch),
        marks AS (SELECT x.batch, max(y.top) AS high FROM latest x LEFT JOIN latest y ON y.batch < x.batch GROUP BY x.batch),
        used AS (
            SELECT nation_id, item_id, a, batch,
                   CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS cents
            FROM cut JOIN marks USING (batch) JOIN vendors USING (vendor_id) JOIN items USING (item_id)
            WHERE nation_id IS NOT NULL AND (high IS NULL OR s + 3 >= high)
        ),
        daily AS (SELECT nation_id, item_id, a, sum(cents) AS cents FROM used GROUP BY ALL),
        running AS (
            SELECT nation_id, item_id, a, sum(cents) OVER p AS revenue, coalesce(lead(a) OVER p, 1000000) AS upto
            FROM daily WINDOW p AS (PARTITION BY nation_id, item_id ORDER BY a)
        ),
        days AS (SELECT nation_id, a AS d, lag(a) OVER (PARTITION BY nation_id ORDER BY a) AS before FROM (SELECT DISTINCT nation_id, a FROM daily)),
        ranked AS (
            SELECT nation_id, d, item_id, row_number() OVER (PARTITION BY nation_id, d ORDER BY revenue DESC, item_id) AS r
            FROM running JOIN days USING (nation_id) WHERE a <= d AND d < upto AND revenue > 0
        ),
        boards AS (SELECT * FROM ranked WHERE r <= 10),
        old AS (SELECT nation_id, days.d, item_id, r FROM boards JOIN days USING (nation_id) WHERE days.before = boards.d),
        changed AS (
            SELECT coalesce(n.nation_id, o.nation_id) AS nation_id, coalesce(n.d, o.d) AS d, coalesce(n.item_id, o.item_id) AS item_id, o.r AS old_rank, n.r AS new_rank
            FROM boards n FULL JOIN old o ON n.nation_id = o.nation_id AND n.d = o.d AND n.item_id = o.item_id
            WHERE o.r IS DISTINCT FROM n.r
        )
        SELECT c.nation_id, c.d AS arrival_day, c.item_id, CAST(least(10, 1 + CAST(floor((c.d - 19723) * 10 / 180) AS BIGINT)) AS INTEGER) AS batch,
               CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
               CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(revenue AS BIGINT) AS revenue
        FROM changed c JOIN running r ON r.nation_id = c.nation_id AND r.item_id = c.item_id AND r.a <= c.d AND c.d < r.upto
    """


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id gets a period from some word on; a null id none."""

    def planted(ws: Column) -> Column:
        n, g = F.size(ws), F.expr("__h div 10")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        return let(F.struct(a.cast("int").alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ws, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))), " "))

    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("__h"))
    changed = let(words(F.col("text")), lambda ws: F.when(F.size(ws) > 0, planted(ws)))
    return hashed.select("doc_id", F.when(F.col("__h") % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(_table(spark, sf_dir, "documents"))
    found = periodic_runs.find(docs).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("b"), F.array_join(lines, "").alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("b.start")).alias("start"),
        F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sql() -> str:
    return rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h
            FROM documents
        ),
        sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM docs),
        placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
        stepped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        planted AS (
            SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS ws
            FROM stepped
        ),
        words AS (SELECT rid, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM planted),
        -- a run of period p begins with max(p, 12 - p) or more places in a row whose word comes again p words on
        pairs AS (SELECT x.rid, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
        enough AS (SELECT rid, p FROM pairs GROUP BY rid, p HAVING count(*) >= greatest(p, 12 - p)),
        islands AS (
            SELECT rid, p, min(i) AS start, count(*) + p AS length
            FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS island FROM pairs SEMI JOIN enough USING (rid, p))
            GROUP BY rid, p, island HAVING count(*) >= greatest(p, 12 - p)
        ),
        runs AS (SELECT rid, start, length, min(p) AS period FROM islands GROUP BY rid, start, length),
        by_doc AS (
            SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                   list(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS best
            FROM runs GROUP BY rid
        ),
        dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS body FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1].start AS start, CAST(best[1].length AS BIGINT) AS length, best[1].period AS period,
               CAST(1000 * best[1].length // best[1].period AS BIGINT) AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM planted LEFT JOIN by_doc USING (rid) LEFT JOIN kept USING (rid)
    """


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_top_k": op3_top_k,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_ids": op8_token_ids,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_decontamination": op11_decontamination,
    "op12_leaderboard": op12_leaderboard,
    "op13_periodic_runs": op13_periodic_runs,
}


def oracles() -> dict[str, str]:
    return {"op2_sharding": op2_sql(), "op3_top_k": op3_sql(), "op7_quality_rules": op7_sql(), "op11_decontamination": op11_sql(), "op12_leaderboard": op12_sql(), "op13_periodic_runs": op13_sql()}
