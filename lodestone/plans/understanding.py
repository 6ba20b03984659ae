"""Query understanding over the benchmark questions and the conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import understand as un
from lodestone.plans.registry import query, view
from lodestone.plans.retrieval import phrases_sql, weight_sql
from lodestone.plans.views import Views

# Every text a user could ask: whole benchmark texts and all conversation turns.
view("v_asked", r"""
SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'm' || conversation_id || '-' || turn, content FROM v_messages""")


def asked(t: Views):
    a = t.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    b = t.messages.select(F.concat(F.lit("m"), "conversation_id", F.lit("-"), "turn").alias("id"), F.col("content").alias("text"))
    return a.unionByName(b)


def any_sql(column: str, phrases: list[str]) -> str:
    return f"(({phrases_sql(column, phrases)}) > 0)"


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> '')"


@query("query_class", f"""
SELECT id, CASE WHEN k > s THEN 'keyword_heavy' WHEN s > k THEN 'semantic_heavy' ELSE 'balanced' END AS class,
       round({weight_sql('text')}, 6) AS weight, {any_sql('text', un.VISUAL_TRIGGERS)} AS visual
FROM (SELECT *, {phrases_sql('text', un.KEYWORD_TRIGGERS)} AS k, {phrases_sql('text', un.SEMANTIC_TRIGGERS)} AS s FROM v_asked)""")
def query_class(t: Views):
    q = F.col("text")
    return asked(t).select(
        "id", un.hybrid_class(q).alias("class"), F.round(un.adaptive_weight(q), 6).alias("weight"), un.wants_visual(q).alias("visual")
    )


@query("identifiers", r"""
SELECT query_id, CAST(generate_subscripts(ids, 1) - 1 AS INT) AS pos, unnest(ids) AS ident FROM (
  SELECT query_id, regexp_extract_all(text, '(?i)\b(?:SKU-[A-Z0-9-]+|FIG-[A-Z0-9-]+|site\s+[0-9]+)\b') AS ids FROM v_lookups)""")
def identifiers(t: Views):
    from lodestone.operators import lexical

    text = F.concat(
        F.lit("Where are SKU-"), "s_nationkey", F.lit("-"), "s_suppkey", F.lit(" and site "), F.col("s_suppkey") % 50, F.lit("?")
    )
    return t.table("supplier").select(
        F.col("s_suppkey").alias("query_id"), F.posexplode(lexical.identifiers(text)).alias("pos", "ident")
    )


@query("route", f"""
SELECT id, CASE WHEN {TRIM.format('text')} = '' THEN 'HYBRID'
  WHEN regexp_matches(text, '\\p{{Nd}}') OR contains(text, '"') OR contains(text, '''') OR len({WORDS.format('text')}) <= 4 THEN 'KEYWORD'
  WHEN {any_sql('text', un.ROUTE_TRIGGERS)} THEN 'SEMANTIC' ELSE 'HYBRID' END AS strategy FROM v_asked""")
def route(t: Views):
    return asked(t).select("id", un.route(F.col("text")).alias("strategy"))


@query("injection", rf"""
SELECT id, f AS flagged, CASE WHEN f THEN regexp_replace(text, '#{{3,}}|\*{{3,}}|-{{3,}}', '', 'g') ELSE text END AS clean
FROM (SELECT *, {any_sql('text', un.INJECTION_PHRASES)} OR length(text) > 10000 AS f FROM v_asked)""")
def injection(t: Views):
    return asked(t).select("id", un.is_injection(F.col("text")).alias("flagged"), un.sanitize(F.col("text")).alias("clean"))


QWORDS = "[" + ", ".join(f"'{w}'" for w in un.QUESTION_WORDS) + "]"


@query("hyde_plan", f"""
SELECT id, CASE WHEN f > o THEN 'factual' WHEN o > 0 THEN 'opinion' ELSE 'neutral' END AS kind, s AS simple,
       CASE WHEN f > o AND NOT s THEN 3 ELSE 2 END AS n
FROM (SELECT id, {phrases_sql('text', un.FACTUAL_PHRASES)} AS f, {phrases_sql('text', un.OPINION_PHRASES)} AS o,
        len(w) <= 4 OR len(list_filter(w, lambda x: list_contains({QWORDS}, x))) >= len(w) * 0.6 AS s
      FROM (SELECT *, {WORDS.format('text')} AS w FROM v_asked))""")
def hyde_plan(t: Views):
    q = F.col("text")
    return asked(t).select(
        "id", un.question_type(q).alias("kind"), un.is_simple(q).alias("simple"), un.hyde_count(q).alias("n")
    )


@query("hyde_gate", f"""
SELECT conversation_id, turn, length({TRIM.format('content')}) BETWEEN 30 AND 600
  AND NOT {any_sql('content', un.HEDGING_PHRASES)} AS usable FROM v_messages WHERE role = 'assistant'""")
def hyde_gate(t: Views):
    return t.messages.where("role = 'assistant'").select("conversation_id", "turn", un.hyde_usable(F.col("content")).alias("usable"))


@query("variations", r"""
SELECT answer_id, CAST(i AS INT) AS n, v AS variation FROM (
  SELECT answer_id, i, s AS v, row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS i2 FROM (
    SELECT answer_id, s, min(i) AS i FROM (
      SELECT answer_id, evidence AS s, -1 AS i FROM v_answers
      UNION ALL
      SELECT answer_id, regexp_replace(unnest(string_split(answer, chr(10))), '^\s+|\s+$', '', 'g') AS s,
             generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM v_answers)
    WHERE i = -1 OR length(s) > 5 GROUP BY ALL))
WHERE i2 < 4""".replace("CAST(i AS INT)", "CAST(i2 AS INT)"))
def variations(t: Views):
    from lodestone.plans.grounding import answers

    lines = un.variations(F.col("evidence"), F.col("answer"))
    return answers(t).select("answer_id", F.posexplode(lines).alias("n", "variation"))


@query("cache_ttl", f"SELECT id, CASE WHEN {any_sql('text', un.TIME_PHRASES)} THEN 3600 ELSE 86400 END AS ttl FROM v_asked")
def cache_ttl(t: Views):
    return asked(t).select("id", un.cache_ttl(F.col("text")).alias("ttl"))


view("v_routed_text", r"""
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN ' semantic search' WHEN 'O' THEN 'Keyword' ELSE o_orderpriority END AS output FROM orders""")


@query("route_parse", r"""
SELECT id, CASE WHEN w IN ('SEMANTIC', 'KEYWORD', 'HYBRID') THEN w ELSE 'HYBRID' END AS strategy
FROM (SELECT id, upper(list_filter(string_split_regex(output, '\s+'), lambda x: x <> '')[1]) AS w FROM v_routed_text)""")
def route_parse(t: Views):
    status = F.col("o_orderstatus")
    output = F.when(status == "F", " semantic search").when(status == "O", "Keyword").otherwise(F.col("o_orderpriority"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), un.parse_route(output).alias("strategy"))


@query("json_title", r"""
SELECT conversation_id, turn, regexp_replace(content, '^\s+|\s+$', '', 'g')[1:60] AS title FROM v_messages""")
def json_title(t: Views):
    """A title inside a model's free text: whole messages wrapped as JSON between other words."""
    output = F.concat(F.lit("Sure, here it is: "), F.to_json(F.struct(F.col("content").alias("title"))), F.lit(" done"))
    return t.messages.select("conversation_id", "turn", un.json_field(output, "title", 60).alias("title"))


@query("slug", r"""
SELECT *, CASE WHEN slug = '' THEN 'empty' WHEN length(slug) > 64 THEN 'too long'
  WHEN NOT regexp_full_match(replace(slug, '_', ''), '[\p{L}\p{N}]+') THEN 'not alphanumeric'
  WHEN slug IN (SELECT replace(lower(p_type), ' ', '_') FROM part) THEN 'reserved' END AS problem
FROM (SELECT doc_id, replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), ' ', '_') AS slug FROM documents)""")
def slug(t: Views):
    """Every text as a skill name; part types are the reserved names."""
    from lodestone.operators.tenancy import check_names

    names = t.table("documents").select("doc_id", un.slug(F.col("text")).alias("slug"))
    reserved = t.table("part").select(un.slug(F.col("p_type")).alias("slug"))
    return check_names(names, reserved)
