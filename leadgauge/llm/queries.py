"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from leadgauge.llm import (
    chat,
    decontaminate,
    filter_audit,
    jaccard_join,
    mixing,
    quality,
    secret_scan,
    substring_dedup,
    token_count,
    topk,
    toxicity,
    vector_codes,
    warc,
)
from leadgauge.llm.shared import ship_package

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.taken_words(mixed).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.number_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    spans = secret_scan.listed(F.col("spans")).alias("spans")
    digest = F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256")
    return found.select("row.doc_id", *counts, digest, spans)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


#: What the calls made of a user's turn must hold.
CHECK = {"type": "object", "properties": {"turn": {"type": ["integer", "null"], "minimum": 0}}, "required": ["turn"]}
ASK = {
    "type": "object",
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "required": ["prompt", "turn"],
    "additionalProperties": False,
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool use: a user's turn calls `ask`, needing the call two turns before if the turn is no early
    one, and the `check` of its own message, which is given after it; an assistant's turn is the result of the `ask` one turn before."""
    turn = F.col("turn")
    number = F.concat(F.lit("c"), turn.cast("string"))
    check = F.concat(F.lit("k"), turn.cast("string"))
    before = F.when(turn >= 3, F.array(F.concat(F.lit("c"), (turn - 2).cast("string")))).otherwise(F.array().cast("array<string>"))

    def call(number: F.Column, name: str, prompt: F.Column, after: F.Column) -> F.Column:
        arguments = F.struct(prompt.alias("prompt"), turn.alias("turn")).alias("arguments")  # JSON leaves a null prompt out
        return F.struct(number.alias("id"), F.lit(name).alias("name"), arguments, after.alias("after"))

    none = F.array().cast("array<string>")
    ask = call(number, "ask", F.col("text"), F.concat(before, F.array(check)))
    calls = F.to_json(F.struct(F.array(ask, call(check, "check", F.lit(None).cast("string"), none)).alias("tool_calls")))
    answer = F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id")
    text = (
        F.when(F.col("role") == "user", calls)
        .when(F.col("role") == "assistant", F.to_json(F.struct(answer, F.col("text").alias("content"))))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked_calls(tool_messages(read(spark, sf_dir, "conversations")), {"ask": ASK, "check": CHECK})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return jaccard_join.jaccard_components(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.page_records(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_topk": op10_topk,
    "op11_warc": op11_warc,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
}


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Each round as two common table expressions: the assignment, then the means."""
    assigned = """
        a{r} as materialized (
            select vec_id, p, min([d, entry]) as best from (
                select x.vec_id, x.p, b.entry,
                       list_sum(list_transform(list_zip(x.x, b.x), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint as d
                from parts x join b{r} b using (p)
            ) group by all
        )"""
    moved = """
        m{r} as materialized (
            select p, entry, list((s - ((s % n) + n) % n) // n order by i) as x from (
                select p, best[2] as entry, i, sum(x[i])::bigint as s, count(*) as n
                from a{r} join parts using (vec_id, p), lateral (select unnest(range(1, len(x) + 1)) as i)
                group by all
            ) group by all
        ),
        b{next} as materialized (select p, entry, coalesce(m.x, b.x) as x from b{r} b left join m{r} m using (p, entry))"""
    steps = [assigned.format(r=r) + "," + moved.format(r=r, next=r + 1) for r in range(rounds)]
    steps.append(assigned.format(r=rounds))
    return f"""
        with kept as (
            select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        parts as materialized (
            select vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) as t(p)
        ),
        ranked as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept),
        b0 as materialized (select p, entry, x from parts join ranked using (vec_id) where entry < {entries}),
        {",".join(steps)},
        coded as (
            select vec_id, string_agg(printf('%02x', best[2]), '' order by p) as code, sum(best[1])::bigint as error
            from a{rounds} group by vec_id
        ),
        digest as (
            select sha256(string_agg(array_to_string(x, ','), ',' order by p, entry)) as codebooks_sha256 from b{rounds}
        )
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded join kept using (vec_id), digest
    """

SQL: dict[str, str] = {
    "op4_chat": """
        with u as (select * from conversations where role = 'user'),
        a as (select * from conversations where role = 'assistant'),
        linked as (
            select u.conv_id, u.turn, u.text, a.turn as result_turn, a.text as content,
                   u.turn >= 3 as needs,
                   case when coalesce(length(u.text), 0) = 0 then 'invalid'
                        when u.turn >= 3 and p.turn is null then 'dangling'
                        when a.turn is null then 'unanswered'
                        else 'ok' end as status
            from u
            left join a on a.conv_id = u.conv_id and a.turn = u.turn + 1
            left join u p on p.conv_id = u.conv_id and p.turn = u.turn - 2
        )
        select conv_id, turn, 0::integer as place, 'k' || turn as call_id, 'check' as name, 'unanswered' as status,
               null as result_turn,
               '{"after":[],"arguments":{"turn":' || turn || '},"id":"k' || turn
               || '","name":"check","result":null,"status":"unanswered"}' as call
        from u
        union all
        select conv_id, turn, 1::integer as place, 'c' || turn as call_id, 'ask' as name, status, result_turn,
               '{"after":[' || case when needs then '"c' || (turn - 2) || '",' else '' end || '"k' || turn
               || '"],"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn
               || '},"id":"c' || turn || '","name":"ask","result":'
               || case when result_turn is null then 'null' else to_json(content)::varchar end
               || ',"status":"' || status || '"}' as call
        from linked
    """,
    "op6_jaccard_join": r"""
        with recursive w as (
            select row_number() over () as r, doc_id, regexp_extract_all(
                translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
            ) as ws
            from documents
        ),
        s as materialized (
            select r, unnest(list_distinct(
                case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end
            )) as g
            from w
        ),
        n as materialized (select r, count(*) as n from s group by r),
        c as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r <> b.r group by all),
        l as materialized (
            select x, y from c join n as p on p.r = x join n as q on q.r = y where 100 * c >= 85 * (p.n + q.n - c)
        ),
        reached(r, z) as (select r, r from w union select reached.r, l.y from reached join l on l.x = reached.z)
        select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id
        from w join reached on reached.r = w.r join w as o on o.r = reached.z left join n on n.r = w.r
        group by w.r, w.doc_id
    """,
    "op10_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vector
            from embeddings
            where embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id,
                   list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]))::bigint as score
            from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
        ),
        ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as "rank"
            from scored
        )
        select query_id, "rank", vec_id, score from ranked where "rank" <= 5
    """,
    "op11_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        g as (select *, max(page_id) over (partition by html) as last, strlen(html) as n from p)
        select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest,
               case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and page_id <> last then last end as refers_to
        from g
    """,
    "op12_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') as part, coalesce("text", '') as t from documents),
        w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first from d),
        l as (
            select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
            from labels group by doc_id
        ),
        h as (
            select part,
                   case when len(ws) < 50 then 'A' else '' end
                   || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
                   || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end
                   || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
                   || case when w.doc_id > first then 'E' else '' end as fails,
                   count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
            from w left join l on l.doc_id = w.doc_id group by all
        ),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (
            select a.x || b.x || c.x || d.x || e.x as filter_order
            from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        steps as (
            select filter_order, step::integer as step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as before
            from orders, range(1, 6) as s(step)
        ),
        met as (
            select h.*, s.*, contains(fails, x) as failing, length(translate(before, fails, '')) < step - 1 as gone
            from h, steps s
        ),
        counted as (
            select part, filter_order, step, x,
                   coalesce(sum(n) filter (not gone and not failing), 0)::bigint as kept,
                   coalesce(sum(n) filter (not gone and failing), 0)::bigint as removed,
                   coalesce(sum(n) filter (gone and failing), 0)::bigint as redundant,
                   coalesce(sum(n) filter (fails = x), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (not gone and failing), 0)::bigint as good_lost,
                   coalesce(sum(toxic) filter (not gone and failing), 0)::bigint as toxic_lost
            from met group by all
        )
        select * exclude (x), (sum(removed) over (partition by part, x))::bigint as shapley from counted
    """,
    "op13_vector_codes": _vector_codes_sql(),
}
