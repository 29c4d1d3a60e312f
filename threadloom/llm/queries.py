"""One query for each operator of this package, over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import (
    bpe, chat, html_text, mixture, nn_descent, order_minhash, quality, repair, secret_scan, shards, toxicity, url_rules, whitening,
)
from threadloom.llm.common import Scratch, shared_folder, table
from threadloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


@query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.near_classes(docs).select("doc_id", "class_id", "class_rows")


@query
def op2_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    text_part = F.array(F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages"))))
    typed = turns.unionByName(extra).select("conv_id", "turn", "role", text_part.cast(chat.PARTS).alias("parts"))
    formatted = chat.format_chats(typed)
    read = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    text = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return text


sql(
    "op2_typed_parts",
    f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
    ), learned AS (
      SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a, count(*) AS n_turns,
             sum({len(chat.TURN) + 1 + len(chat.END)} + length(role) + length({_escaped_sql("text")})) AS formatted_chars
      FROM t GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(a) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
           CAST(formatted_chars AS BIGINT) AS formatted_chars
    FROM learned
    """,
)


@query
def op3_block_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the words of it that the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_forest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, with the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan(docs, secret_scan.fitted(docs)).withColumn("f", F.explode("findings"))
    value = F.substring(F.col("text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    return found.select(
        "doc_id", F.col("f.start").cast("long").alias("start"), F.length(value).cast("long").alias("length"),
        F.sha2(value, 256).alias("value_sha256"), (F.col("f.score") >= secret_scan.THRESHOLD).alias("is_secret"),
        F.round("f.score", 3).alias("score"),
    )


@query
def op5_ratio_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = Scratch(spark, "quality").write(quality.measure(docs).drop("text"), "measured")
    return quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quality_sql(limits: quality.Limits = quality.Limits()) -> str:
    listed = " ".join(f"WHEN '{g}' THEN {ws!r}" for g, ws in quality.COMMON_WORDS.items())
    steps = []
    for k, pattern in enumerate(quality.CHARACTER_CLASSES.values(), 1):
        quoted = pattern.replace("'", "''")
        steps.append(f"SELECT *, regexp_replace(x{k - 1}, '{quoted}', '', 'g') AS x{k} FROM s{k - 1}")
    chain = "".join(f", s{k} AS ({step})" for k, step in enumerate(steps, 1))
    n = len(steps)
    sizes = ", ".join(["length(t) - length(x0)", *(f"length(x{k - 1}) - length(x{k})" for k in range(1, n + 1)), f"length(x{n})"])

    def distances(refs: str) -> str:
        return f"""
          SELECT rid, kind, sqrt(greatest(sum(
              (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS d
          FROM (SELECT h.rid, h.kind, h.c / nullif(sum(h.c) OVER (PARTITION BY h.rid, h.kind), 0) AS p,
                       r.c / nullif(sum(r.c) OVER (PARTITION BY h.rid, h.kind), 0) AS q
                FROM hist h JOIN {refs} r USING (lang, kind, i))
          WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY rid, kind"""

    def verdicts(distance: str) -> str:
        return f"""
          SELECT b.*, NOT base_failed AND NOT (cd > {limits.max_char_distance} OR (cd > {limits.joint_char_distance} AND wd > {limits.joint_word_distance})) AS kept
          FROM (SELECT f.*, CASE WHEN length(t) >= {limits.min_chars} THEN coalesce(c.d, 0) ELSE 0 END AS cd,
                       CASE WHEN n_words >= {limits.min_joint_words} THEN coalesce(w.d, 0) ELSE 0 END AS wd,
                       n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed
                FROM figures f LEFT JOIN {distance} c ON c.rid = f.rid AND c.kind = 'chars' LEFT JOIN {distance} w ON w.rid = f.rid AND w.kind = 'words') b"""

    return rf"""
    WITH a AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
    s0 AS (SELECT *, array_to_string(ws, '') AS x0 FROM a){chain},
    wins AS (SELECT rid, i, ws[i:i + 4] AS k FROM a, UNNEST(range(1, len(ws) - 3)) u(i) WHERE len(ws) >= 5),
    twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM wins) WHERE c > 1),
    covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, UNNEST(range(0, 5)) v(d) GROUP BY rid),
    lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM a, UNNEST(string_split(t, chr(10))) v(l)
              WHERE regexp_matches(l, '[^ 	-
]') GROUP BY rid),
    figures AS (SELECT rid, doc_id, lang, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(x0) AS BIGINT) AS word_chars,
                       CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                       CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                       [{sizes}] AS chars
                FROM s{n} LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
    found AS (SELECT *, list_transform(CASE lang {listed} END, lambda c: len(list_filter(ws, lambda y: y = c))) AS hits
              FROM figures WHERE lang IN {tuple(quality.COMMON_WORDS)}),
    hist AS (SELECT rid, lang, 'chars' AS kind, generate_subscripts(chars, 1) AS i, unnest(chars) AS c FROM found
             UNION ALL SELECT rid, lang, 'words', generate_subscripts(l, 1), unnest(l)
             FROM (SELECT rid, lang, list_append(hits, len(ws) - list_sum(hits)) AS l FROM found)),
    refs1 AS (SELECT lang, kind, i, sum(c) AS c FROM hist GROUP BY ALL),
    d1 AS ({distances("refs1")}),
    v1 AS ({verdicts("d1")}),
    refs2 AS (SELECT h.lang, kind, i, sum(c) AS c FROM hist h JOIN v1 USING (rid) WHERE kept GROUP BY ALL),
    d2 AS ({distances("refs2")}),
    v2 AS ({verdicts("d2")})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v2
    """


sql("op6_distribution_divergence", _quality_sql())


@query
def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    return shards.shard(docs, shared_folder(spark, "slot-map")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th one."""
    return nn_descent.nearest(table(configure(spark), sf_dir, "embeddings").select("vec_id", "embedding"))


#: The rules of the query: fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op9_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, spark.createDataFrame(URL_RULES, url_rules.RULES))


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return rf"""
    WITH r(rh, rp, v) AS (VALUES {rules}),
    u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, row_number() OVER () AS rid, regexp_extract(rest, '^[^/?#]*') AS host0, rest FROM u),
    p AS (SELECT page_id, rid, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substring(rest, length(host0) + 1), '^[^?#]*') AS path FROM h),
    f AS (SELECT rid, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(v, length(rh || rp) * 1000 + length(rh)) AS v
          FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f USING (rid)
    """


sql("op9_range_join", _url_sql())


#: Rank file of the tokenizer, as named in the installed package of public vocabularies.
RANK_FILE = "byte_bpe_50k.tiktoken"


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


@query
def op11_levenshtein_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(configure(spark), sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op12_parallel_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the checksums of its rows, with its faults and cheapest repair."""
    turns = table(configure(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_rows(repair.in_order(repair.damage(turns)), turns)


def _repair_sql() -> str:
    crc = """xor(4294967295, list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT)),
        lambda c, b: list_reduce(range(0, 8), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
        CAST(4294967295 AS BIGINT)))"""

    def path(state: str, cost: str, letter: str, line: str | None) -> str:
        out = f"{state}.o" if line is None else f"list_append({state}.o, {line})"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}}"

    def best(*paths: str) -> str:
        # Costs first, then audits; equal audits have equal lines.
        return f"list_min([{', '.join(paths)}])"

    def insert(state: str) -> str:
        return path(state, "5", "I", "'user:'" if state != "s.u" else "'assistant:'")

    # Rows are inserted first: a user row, then an assistant row behind a user row that may itself be inserted.
    fill = f"""list_transform([s], lambda s: {{'n': s.n, 's': s.s, 'a': s.a, 'u': {best("s.u", *(insert(f"s.{x}") for x in "nsa"))}}})[1]"""
    fill = f"""list_transform([{fill}], lambda s: {{'n': s.n, 's': s.s, 'u': s.u, 'a': {best("s.a", insert("s.u"))}}})[1]"""

    def kept(state: str, initial: str) -> str:
        free = f"CASE WHEN x.i = '{initial}' AND x.f NOT IN ('b', 'd') THEN 0 ELSE 1000000 END + CASE WHEN x.f = 't' THEN 5 ELSE 0 END"
        return path(state, free, "K", "x.r || ':' || x.t")

    def reroled(state: str, role: str) -> str:
        free = "CASE WHEN x.f NOT IN ('b', 'd') THEN 1 ELSE 1000000 END + CASE WHEN x.f = 't' THEN 5 ELSE 0 END"
        return path(state, free, "R", f"'{role}:' || x.t")

    def deleted(state: str) -> str:
        return path(state, "2", "D", None)

    row = f"""list_transform([{fill}], lambda s: {{
        'n': {deleted("s.n")}, 's': {best(deleted("s.s"), kept("s.n", "s"))},
        'u': {best(deleted("s.u"), *(kept(f"s.{x}", "u") for x in "nsa"), *(reroled(f"s.{x}", "user") for x in "nsa"))},
        'a': {best(deleted("s.a"), kept("s.u", "a"), reroled("s.u", "assistant"))}}})[1]"""
    start = ", ".join(f"'{x}': {{'c': {0 if x == 'n' else 1000000}, 'a': '', 'o': CAST([] AS VARCHAR[])}}" for x in "nsua")
    return rf"""
    WITH k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k,
                      coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations),
    d AS (SELECT *, ({crc}) % 20 AS fault FROM k),
    rows_ AS (SELECT conv_id, turn, r0, t0, copy, CASE WHEN fault = 4 THEN 'user' ELSE r0 END AS r,
                     CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS t
              FROM d, UNNEST(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) v(copy) WHERE fault <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, copy) AS pos,
                      CASE WHEN substr(r, 1, 1) IN ('s', 'u', 'a') THEN substr(r, 1, 1) ELSE 'o' END AS i,
                      regexp_extract(t, '([^ 	-
])[ 	-
]*$', 1) AS e FROM rows_),
    marked AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, r, t ORDER BY pos) > 1 THEN 'd'
                              WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS f,
                      lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM placed),
    convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
                     count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
                     count(*) FILTER (earlier || i NOT IN ('su', 'ua', 'au')) AS illegal,
                     list({{'i': i, 'f': f, 'r': r, 't': t}} ORDER BY pos) AS xs FROM marked GROUP BY conv_id),
    reached AS (SELECT *, list_reduce(xs, lambda s, x: {row}, {{{start}}}) AS s FROM convs),
    ended AS (SELECT *, list_min([s.n, ({fill}).a]) AS p FROM reached)
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.c, 0) AS cost, coalesce(p.a, '') AS audit,
           sha256(coalesce(array_to_string(p.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
    """


sql("op12_parallel_viterbi", _repair_sql())


@query
def op13_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the whitened components of the table."""
    return whitening.whiten(table(configure(spark), sf_dir, "embeddings").select("vec_id", "embedding"))
