"""The registered queries of the operators, and the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercash.llm import (
    decontamination,
    divergence,
    html_extraction,
    jaccard_join,
    license_scan,
    merkle,
    packing,
    partial_matching,
    quality_classifier,
    quality_rules,
    quote_linking,
    sharding,
    warc,
)
from ordercash.llm.common import crc_of_id, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_matching.scores(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.linked(docs).select(
        "doc_id", F.col("group_id").alias("class_id"), "n_links", "n_texts"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.read_shards(docs, sharding.write_shards(docs, shards=16), shards=16)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )


def op4_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as mail that quotes the turns before; without quotes they are the turns again."""
    mail = quote_linking.as_mail(table(spark, sf_dir, "conversations"))
    return quote_linking.conversations(mail)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer())
    placed = packing.packed(written(cut, "pieces"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, archives, split_bytes=4 << 20, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.pmod(crc_of_id("doc_id"), F.lit(quality_classifier.HELD_OUT)) == 0
    scored = docs.select(
        "doc_id", held_out.alias("held_out"), quality_classifier.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= quality_classifier.CUT).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("record.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, checked against rows of which a fifth are tampered with."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_digest([lower if c == "text" else F.col(c) for c in merkle.FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), claim=F.when(hit, tampered))
    told = rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        merkle.digest(merkle.proof_text(F.col("proof"))).alias("proof_sha256"),
        merkle.folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extraction.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_partial_matching, op2_jaccard_join, op3_sharding, op4_quote_linking,
        op5_quality_rules, op6_license_scan, op7_packing, op8_warc, op9_quality_classifier,
        op10_decontamination, op11_merkle, op12_divergence, op13_html_extraction,
    )
}

def _merkle_sql(levels: int, above: int) -> str:
    """The levels of the trees and of the tree above them, written out; a lone node passes on its digest."""

    def up(name: str, n: int) -> list[str]:
        return [
            f"""{name}{k + 1} AS (
        SELECT tree, place // 16 AS place, (size + 15) // 16 AS size,
            CASE WHEN size = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest,
            CASE WHEN size = 1 THEN [] ELSE list(digest ORDER BY place) END AS run
        FROM {name}{k} GROUP BY tree, place // 16, size)"""
            for k in range(n)
        ]

    def joined(name: str, n: int, tree: str, place: str) -> str:
        return "".join(
            f" JOIN {name}{k + 1} AS {name}r{k + 1} ON {name}r{k + 1}.tree = {tree}"
            f" AND {name}r{k + 1}.place = {place} // {16 ** (k + 1)}"
            for k in range(n)
        )

    def sides(name: str, n: int, place: str) -> list[tuple[str, str]]:
        out = []
        for k in range(n):
            run, at = f"{name}r{k + 1}.run", f"{place} // {16 ** k} % 16"
            out.append((f"array_to_string({run}[:{at}], '')", f"array_to_string({run}[{at} + 2:], '')"))
        return out

    steps = sides("t", levels, "l.place") + sides("s", above, "b.place")
    fold = "claim"
    folds = []
    for k, (left, right) in enumerate(steps):
        folds.append(f"CASE WHEN size{k} = 1 THEN {fold} ELSE sha256(l{k} || {fold} || r{k}) END AS f{k}")
        fold = f"f{k}"
    parts = ", ".join(
        f"{left} AS l{k}, {right} AS r{k}, "
        + (f"len(tr{k + 1}.run)" if k < levels else f"len(sr{k - levels + 1}.run)") + f" + 1 AS size{k}"
        for k, (left, right) in enumerate(steps)
    )
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def leaf(text: str) -> str:
        each = (f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in fields)
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in each
        ) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    nested = "told"
    chain = []
    for k, f in enumerate(folds):
        chain.append(f"folded{k} AS (SELECT *, {f} FROM {nested})")
        nested = f"folded{k}"
    return ",\n".join([
        f"""WITH RECURSIVE bits AS (
        SELECT doc_id, CAST(doc_id AS VARCHAR) AS raw FROM documents WHERE doc_id IS NOT NULL),
    crc AS (
        SELECT DISTINCT doc_id, raw, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM bits
        UNION ALL
        SELECT doc_id, raw, i + 1, {_crc_step()} FROM crc WHERE i < length(raw)),
    hit AS (SELECT DISTINCT doc_id FROM crc WHERE i = length(raw) AND xor(c, 4294967295) % 5 = 0),
    t0 AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
            count(*) OVER (PARTITION BY tree) AS size
        FROM (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS digest,
            CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {leaf(lower)} ELSE {leaf('text')} END AS claim
            FROM documents))""",
        *up("t", levels),
        f"""s0 AS (
        SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree) - 1 AS place,
            count(*) OVER () AS size FROM t{levels})""",
        *up("s", above),
        f"""told AS (
        SELECT l.doc_id, l.digest AS leaf, l.claim, b.digest AS subroot, top.digest AS root, {parts}
        FROM t0 l JOIN s0 b ON b.of = l.tree JOIN s{above} top ON TRUE
        {joined('t', levels, 'l.tree', 'l.place')}{joined('s', above, "''", 'b.place')})""",
        *chain,
    ]) + f"""
    SELECT doc_id, leaf, subroot, root, sha256({' || '.join(f'l{k} || r{k}' for k in range(len(steps)))}) AS proof_sha256,
        {fold} AS folded_root, {fold} = root AS verified FROM {nested}"""


def _crc_step() -> str:
    """One byte of crc32 more: eight shifts with the polynomial where the lowest bit is set."""
    c = "xor(c, CAST(ascii(substr(raw, i + 1, 1)) AS BIGINT))"
    for _ in range(8):
        c = f"list_transform([{c}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    return c


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    # Every pair that shares an n-gram, counted exactly; groups by walking the links.
    "op2_jaccard_join": rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
    n AS (
        SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(31) ORDER BY gram)) AS same
        FROM g GROUP BY doc_id),
    pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT x, y, a.same <> b.same AS other, b.same
        FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
        WHERE 10 * k >= 8 * (a.n + b.n - k)),
    reach AS (
        SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
    low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
    counts AS (
        SELECT x, count(*) AS n_links, count(DISTINCT same) FILTER (other) AS n_texts
        FROM links GROUP BY x)
    SELECT doc_id, least(doc_id, coalesce(low.y, doc_id)) AS class_id,
        coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts
    FROM d LEFT JOIN low ON low.x = doc_id LEFT JOIN counts ON counts.x = doc_id""",
    # The texts are the turns' own again; a turn replies to the first that says what the turn
    # before it says.
    "op4_quote_linking": r"""
    WITH RECURSIVE t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    said AS (
        SELECT conv_id, turn, trim(regexp_replace(lower(x), '[\x00-\x20]+', ' ', 'g')) AS piece
        FROM (SELECT conv_id, turn, unnest([text] || string_split(text, chr(10))
            || regexp_split_to_array(text, '\n[ \t]*\n')) AS x FROM t)),
    firsts AS (
        SELECT conv_id, piece, min(turn) AS original FROM said WHERE piece <> '' GROUP BY ALL),
    links AS (
        SELECT b.conv_id, b.turn, original AS parent
        FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
            JOIN firsts f ON f.conv_id = a.conv_id
                AND f.piece = trim(regexp_replace(lower(a.text), '[\x00-\x20]+', ' ', 'g'))
        WHERE original < b.turn),
    up AS (
        SELECT conv_id, turn, parent, parent AS start, 1 AS depth FROM links
        UNION ALL
        SELECT u.conv_id, u.turn, u.parent, l.parent, u.depth + 1
        FROM up u JOIN links l ON l.conv_id = u.conv_id AND l.turn = u.start),
    top AS (
        SELECT conv_id, turn, parent, min(start) AS start, max(depth) AS depth
        FROM up GROUP BY conv_id, turn, parent)
    SELECT conv_id, turn, role, text, parent, coalesce(start, turn) AS start,
        CAST(coalesce(depth, 0) AS BIGINT) AS depth
    FROM t LEFT JOIN top USING (conv_id, turn)""",
    "op5_quality_rules": rf"""
    WITH d AS (
        SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {_WORDS} AS w
        FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
    five AS (
        SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d,
            lead(a, 4) OVER o AS e FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n
        FROM five WHERE e IS NOT NULL),
    covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n
        FROM grams, unnest([0, 1, 2, 3, 4]) AS u(k) WHERE n > 1 GROUP BY doc_id),
    lines AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    f AS (
        SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
        FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    b AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
    hosts AS (
        SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY host),
    m AS (
        SELECT sum(n) AS docs, count(*) AS hosts, sum(failed) / sum(n) AS mean,
            sum(failed * failed / n) AS squares FROM hosts),
    e AS (
        SELECT mean, (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean))
            / greatest(docs - hosts, 1) AS excess FROM m),
    prior AS (
        SELECT mean, CASE WHEN excess > 0
            THEN greatest(least(mean * (1 - mean) / excess - 1, 1e6), 1) ELSE 1e6 END AS s FROM e)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND (failed + mean * s) / (n + s) <= 0.5 AS kept
    FROM b JOIN hosts USING (host), prior""",
    "op8_warc": """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size,
            sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (
        SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END
            AS first FROM p)
    SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op10_decontamination": r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)),
    grams AS (
        SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i
            FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
    found AS (
        SELECT doc_id, item, grams.n, i FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
    hit AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # Every group takes every kept term of its lang; a source's shares are set against all others'.
    "op12_divergence": r"""
    WITH d AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    kept AS (
        SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d)
        GROUP BY lang, t HAVING count(*) >= 30),
    n AS (
        SELECT lang, source, t, count(*) AS n
        FROM (SELECT lang, source, unnest(w) AS t FROM d) JOIN kept USING (lang, t) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    every AS (
        SELECT lang, source, t, coalesce(n, 0) AS n
        FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, t)),
    sized AS (
        SELECT *, sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS m
        FROM every),
    p AS (
        SELECT lang, source, t, n, 1 + CAST(1000000000 * CAST(n + 5 AS HUGEINT) // CAST(m AS HUGEINT) AS BIGINT) AS p
        FROM sized),
    l AS (SELECT lang, t, sum(n) AS n FROM every GROUP BY lang, t),
    q AS (
        SELECT lang, t, 1 + CAST(1000000000 * CAST(n + 5 AS HUGEINT)
            // CAST(sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang) AS HUGEINT) AS BIGINT) AS q
        FROM l),
    far AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
    terms AS (
        SELECT lang, source, t AS item, p - q AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
    both_parts AS (
        SELECT *, 'pair' AS part FROM pairs UNION ALL BY NAME SELECT *, 'term' AS part FROM terms),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM both_parts)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM ranked WHERE part = 'pair' OR rank <= 50""",
    # Five levels hold a million leaves a tree, two hold 256 trees.
    "op11_merkle": _merkle_sql(5, 2),
}
