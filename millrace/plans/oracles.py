"""The same results in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

from millrace.plans.bindings import EXTRA_STOPWORDS, RUNS

# The default English stop words of Spark's StopWordsRemover.
ENGLISH_STOPWORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is
    are was were be been being have has had having do does did doing a an the and but if or because as until
    while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more
    most other some such no nor not only own same so than too very s t can will just don should now i'll
    you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
    they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
    won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
    there's what's when's where's who's why's would
""".split()

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in [*ENGLISH_STOPWORDS, *EXTRA_STOPWORDS])

#: The columns of the failure study.
STUDY = """
    select doc_id, cast(toxic as integer) as labels, case when lang = 'en' then 'm' else 'r' end as map_reduce,
        cast(n_chars as double) as plan_cpu, case when lang <> 'de' then cast(len(string_split(text, ' ')) as double) end as cpu_avg,
        cast(len(string_split(text, chr(10))) as double) as cpu_max, cast(quality as double) as quality
    from labels join documents using (doc_id)"""


def key_share(salt: str, *key: str) -> str:
    """The 32 bits that samples and parts by key are drawn by."""
    text = " || '|' || ".join([f"'{salt}'", *(f"coalesce(cast({k} as varchar), '')" for k in key)])
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


_MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"
_SALES = _MONEY.format("l_extendedprice")

_TOTALS = f"""
    select o_orderkey as order_id, o_orderdate as order_date, {_SALES} as sum_goods_price
    from orders join lineitem on o_orderkey = l_orderkey group by 1, 2"""
_TOP_ORDERS = f"""{_TOTALS}
    order by sum_goods_price desc nulls last, order_date desc nulls last, order_id limit 5"""

_WORDS = r"""
    select doc_id, pos, word from (
        select doc_id, unnest(generate_series(1, len(words))) as pos, unnest(words) as word
        from (select doc_id, regexp_split_to_array(lower(text), '[\s\x0B]+') as words from documents)
    ) where word <> ''"""
_KEPT = f"select * from ({_WORDS}) where word not in ({_STOP})"
_VOCABULARY = f"""
    select word as term, count(*) as n_tokens, count(distinct doc_id) as n_docs
    from ({_KEPT}) group by 1"""

_EPOCH_MS = "cast(epoch_us({}) / 1000 as bigint)"
_ORDER_MS = _EPOCH_MS.format("o_orderdate")
_END_MS = f"({_ORDER_MS} + cast(floor(o_totalprice) as bigint))"
_SHIP_MS = _EPOCH_MS.format("l_shipdate")
_AT = "epoch_ms({})"
_STAGE_NAME = "case when o_orderpriority = '1-URGENT' then 'checkpoint at Job.scala:84' else 'count at Job.scala:57' end"
_RUN = "'run-' || cast({} % 64 as varchar)"

# The sixth and seventh task of a stage have started and not finished.
_TASK_COUNTS = f"""
    select l_orderkey, count(*) as started, count(*) filter (l_linenumber < 6) as seen,
        count(*) filter (l_linenumber < 6 and l_returnflag <> 'R' and not (l_returnflag = 'A' and l_linestatus = 'O')) as done,
        count(*) filter (l_linenumber < 6 and l_returnflag = 'R') as failed,
        count(*) filter (l_linenumber < 6 and l_returnflag = 'A' and l_linestatus = 'O') as killed,
        min({_SHIP_MS}) as first
    from lineitem group by 1"""
# Attempts: 0 of every order (it may have tasks, a submission, a completion, or none of these), 1 of failed ones.
_STAGES = f"""
    with base as (
        select *, o_orderpriority = '5-LOW' as unfinished, o_orderpriority <> '5-LOW' or o_orderstatus = 'O' as submitted,
            case when attempt = 0 then coalesce(started, 0) else 0 end as n_started, case when attempt = 0 then coalesce(seen, 0) else 0 end as n_seen
        from orders cross join (select unnest([0, 1]) as attempt) left join ({_TASK_COUNTS}) on l_orderkey = o_orderkey
        where attempt = 0 or (o_orderstatus = 'F' and o_orderpriority <> '5-LOW'))
    select {_RUN.format('o_orderkey')} as app_id,
        case when not unfinished then case when o_orderstatus = 'F' and attempt = 0 then 'FAILED' else 'COMPLETE' end
             when submitted or n_started > 0 then 'ACTIVE' when o_orderkey % 2 = 0 then 'SKIPPED' else 'PENDING' end as status,
        o_orderkey as "stageId", cast(attempt as integer) as "attemptId", 7::integer as "numTasks",
        cast(case when unfinished then n_started - n_seen else 0 end as integer) as "numActiveTasks",
        cast(case when attempt = 0 then coalesce(done, 0) else 0 end as integer) as "numCompleteTasks",
        cast(case when attempt = 0 then coalesce(failed, 0) else 0 end as integer) as "numFailedTasks",
        cast(case when attempt = 0 then coalesce(killed, 0) else 0 end as integer) as "numKilledTasks",
        case when submitted then {_AT.format(f'{_ORDER_MS} + attempt * 1000')} end as "submissionTime",
        case when attempt = 0 then {_AT.format('first')} end as "firstTaskLaunchedTime",
        case when not unfinished then {_AT.format(f'{_END_MS} + attempt * 1000')} end as "completionTime",
        {_STAGE_NAME} as name,
        case when submitted then o_custkey || ',' || o_orderkey else '' end as "rddIds",
        cast(n_seen as integer) as "numSeenTasks"
    from base"""
_TASKS = f"""
    select distinct {_RUN.format('l_orderkey')} as app_id, l_orderkey as "stageId", 0::integer as "attemptId",
        0::integer as "taskAttempt", cast(floor(l_extendedprice) as bigint) as "taskDuration",
        cast(l_suppkey as varchar) as "taskExecutorId", l_linenumber as "taskIndex",
        {_AT.format(_SHIP_MS)} as "taskLaunchTime", l_partkey as "taskId",
        cast(floor(l_quantity) as bigint) as "executorDeserializeTime",
        l_returnflag = 'R' as failed, l_returnflag = 'A' and l_linestatus = 'O' as killed
    from lineitem where l_linenumber < 6"""
_MINUTES = "floor((epoch_us({1}) - epoch_us({0})) / 1000000) / 60"
_TC_STAGE = f"""
    select app_id, "stageId", {_MINUTES.format('"firstTaskLaunchedTime"', '"completionTime"')} as "tcMinStage"
    from ({_STAGES}) where "attemptId" = 0 and status = 'COMPLETE' and contains(name, 'checkpoint')"""

_LOG = """
    select user_id as log, ts, event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k
    from events"""

# Line numbers from 6 on give a run a second row of an order; returned items have no key.
_LONG_RUNS = f"""
    select l_linenumber % {len(RUNS)} + 1 as run, case when l_returnflag <> 'R' then l_orderkey end as l_orderkey,
        l_quantity as quantity, l_partkey as part
    from lineitem"""
_ALIGNED = f"""
    select l_orderkey, {', '.join(f'r{r}.{c} as {c}' + ('' if r == 1 else f'_{r}') for r in RUNS for c in ('quantity', 'part'))}
    from (select * from ({_LONG_RUNS}) where run = 1) r1
    {' '.join(f'join (select * from ({_LONG_RUNS}) where run = {r}) r{r} using (l_orderkey)' for r in RUNS[1:])}"""
_ALL_QUANTITIES = "quantity + quantity_2 + quantity_3 + quantity_4 + quantity_5"

_STAGE_RUNS = f"""
    select l_linenumber % {len(RUNS)} + 1 as run, l_suppkey as "stageId", max(l_quantity) as tc
    from lineitem group by 1, 2"""

_RUNTIMES = """
    select user_id, cast(floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) as bigint) as runtime_s
    from events group by 1"""

_RANK_STEP = """r{0} as (
    select dst as src, 0.15::double + 0.85::double * sum(rank / degree) as rank
    from links join r{1} using (src) group by dst)"""
_PAGERANK = f"""
    with e as (select distinct l_partkey as src, l_suppkey as dst from lineitem),
    degrees as (select src, count(*) as degree from e group by 1),
    links as (select src, dst, degree from e join degrees using (src)),
    r0 as (select src, 1.0::double as rank from degrees),
    {', '.join(_RANK_STEP.format(i, i - 1) for i in (1, 2, 3))}
    select src as node, round(rank, 6) as rank from r3"""

_PAGERANK_ALL = """
    with recursive e as (select distinct l_partkey as src, l_suppkey as dst from lineitem),
    degrees as (select src, count(*) as degree from e group by 1),
    links as materialized (select src, dst, degree from e join degrees using (src)),
    r(round, src, rank) as (
        select 0, src, 1.0::double from degrees
        union all
        select round + 1, dst, 0.15::double + 0.85::double * sum(rank / degree)
        from links join r using (src) where round < 100 group by round, dst)
    select src as node, round(rank, 6) as rank from r where round = 100"""

_NEAREST = """
    with x as (
        select vec_id, label, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as v
        from embeddings),
    centres as (select label as cluster, i, avg(v) as c from x group by 1, 2),
    d as (select vec_id, cluster, sum((v - c) * (v - c)) as distance from x join centres using (i) group by 1, 2)
    select vec_id, cast(arg_min(cluster, distance) as bigint) as cluster, min(distance) as distance from d group by 1"""

_STUDY = "from labels join documents using (doc_id)"
# True and false positives at or above each distinct score, in descending order.
_CURVE = f"""
    with s as (
        select n_chars as score, sum(toxic) as p, count(*) - sum(toxic) as n {_STUDY} group by 1),
    c as (
        select score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as all_p, sum(n) over () as all_n
        from s window w as (order by score desc))"""


def _uniform(key: str, label: str, i: int) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {key}, '{label}')), {1 + 10 * i}, 10))::bigint + 0.5::double) / 16.0::double ** 10)"


def _normal(key: str, label: str, function: str) -> str:
    return (f"(sqrt(-2.0::double * ln({_uniform(key, label, 1)})) "
            f"* {function}(2.0::double * pi() * {_uniform(key, label, 2)}))")


_X = f"({_uniform('o_orderkey', 'poly42', 0)} * 10)"
_CLUSTER = f"cast(floor({_uniform('o_orderkey', 'point42', 0)} * 55) as integer)"

ORACLES: dict[str, str] = {
    "app_duration_of_one": """
        select 'customer-7' as app_id, coalesce(max(case when c_mktsegment <> 'MACHINERY' then
            cast(round(abs(c_acctbal) * 100) as bigint) end), 0) as duration_ms
        from customer where c_custkey = 7""",
    "corpus_ids": """
        select count(*) as n_ids, count(*) as n_distinct from (select unnest(string_split(text, chr(10))) from documents)""",
    "approx_medians": """
        select l_suppkey, count(*) as n, true as near from lineitem group by 1
        union all select -1, count(*), true from lineitem having count(*) > 0""",
    "sample_by_key": f"""
        select l_orderkey, l_linenumber, l_partkey from lineitem
        where {key_share("7", "l_orderkey", "l_linenumber")} < 1288490189""",
    "split_by_share": f"""
        select o_orderkey, cast(case when share < 2147483648 then 0 when share < 3221225472 then 1 else 2 end as integer) as part
        from (select o_orderkey, {key_share("part77", "o_orderkey")} as share from orders)""",
    "cv_metrics": """
        select 'selection' as step, 'areaUnderROC' as metric, 'maxBins=' || b || ', maxDepth=' || d as params, 1.0::double as mean, 0.0::double as stddev
        from unnest([12, 20]) as u(b), unnest(generate_series(2, 9)) as v(d) where exists (select * from labels)
        union all select 'evaluation', 'areaUnderPR', '', 1.0::double, 0.0::double""",
    "failure_scores": f"""
        select doc_id, cast(label as integer) as labels, map_reduce, plan_cpu, cpu_avg, cpu_max, quality, label as prediction
        from (select *, cast(map_reduce = 'm' as double) as label from ({STUDY}))
        where {key_share("part77", "doc_id")} >= 3221225472""",
    "curve_areas": f"""
        with counted as (
            select map_reduce, plan_cpu, cast(sum(labels) as double) as p, cast(count(*) - sum(labels) as double) as n from ({STUDY}) group by 1, 2),
        placed as (
            select *, coalesce(sum(p) over w, 0) as tp, coalesce(sum(n) over w, 0) as fp from counted
            window w as (partition by map_reduce order by plan_cpu desc rows between unbounded preceding and 1 preceding))
        select map_reduce, round(sum(n * (tp + p / 2)) / (sum(p) * sum(n)), 6) as roc,
            round(sum(p * ((tp + p) / (tp + p + fp + n) + case when tp + fp > 0 then tp / (tp + fp) else p / (p + n) end) / 2) / sum(p), 6) as pr
        from placed group by map_reduce""",
    "sample_fraction": "select count(*) > 0 as near_share, true as repeatable, true as part_of_rows from lineitem",
    "stopword_list": "select lang as word from documents union select source from documents",
    "drop_listed_words": """
        select token, count(*) as n from (select unnest(string_split(text, ' ')) as token from documents)
        where token <> '' and lower(token) not in (select lower(unnest(string_split(text, ' '))) from benchmark) group by 1""",
    "missing_source": "select count(*) as n_lines, count(n_name) as n_values from nation",
    "numeric_columns": "select o_orderkey, o_totalprice from orders",
    "gbt_steps": """
        select l_orderkey, l_linenumber, cast(l_linenumber * l_linenumber as double) as label,
            cast(l_linenumber * l_linenumber as double) as prediction
        from lineitem where l_orderkey % 10 >= 7""",
    "model_description": """
        select 100::integer as trees, true as same, count(*) as n_rows from lineitem where l_orderkey % 10 >= 7""",
    "kmeans_groups": """
        with p as (select l_suppkey % 4 as g, l_quantity / 50 as x from lineitem),
        m as (select g, avg(x) as c from p group by 1)
        select count(*) as size, round(sum((x - c) * (x - c)), 4) as cost from p join m using (g) group by g""",
    "top_orders": _TOP_ORDERS,
    "top_orders_checkpoint": _TOP_ORDERS,
    "order_totals": _TOTALS,
    "join_orders_items": """
        select o_orderkey as order_id, o_orderdate as order_date,
            cast(cast(l_extendedprice as decimal(18,2)) as double) as goods_price
        from orders join lineitem on o_orderkey = l_orderkey""",
    "scan_orders": """
        select cast(o_orderkey as integer) as order_id,
            case when o_orderstatus <> 'F' then o_custkey end as order_code,
            case when o_orderstatus <> 'P' then cast(o_orderdate as date) end as order_date
        from orders""",
    "scan_sample": "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem",
    "scan_limit": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
        order by 1, 2, 3, 4 limit 10000""",
    "edge_list": """
        select distinct cast(l_partkey as varchar) as src, cast(l_suppkey as varchar) as dst from lineitem""",
    "scan_points": f"""
        select {', '.join(f'cast(embedding[{i + 1}] as double) as x{i}' for i in range(64))} from embeddings""",
    "scan_corpus": "select unnest(string_split(text, chr(10))) as text from documents",
    "ranks_roundtrip": """
        select l_partkey as node, count(distinct l_suppkey) / 7 as rank from lineitem group by 1""",
    "cached_read": "select o_orderkey, o_custkey, o_totalprice from orders",
    "sink_roundtrip": """
        select row_number() over (order by o_orderkey) - 1 as id, o_orderstatus as status, o_orderkey as "stageId",
            '[' || o_custkey || ', ' || o_orderkey || ']' as "rddIds",
            case when o_orderpriority = '1-URGENT' then o_totalprice end as "tcMinStage"
        from orders""",
    "scored_roundtrip": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "line_filter": """
        select line from (select unnest(string_split(text, chr(10))) as line from documents)
        where starts_with(line, 'The')""",
    "app_duration": """
        select 'customer-' || c_custkey as app_id,
            case when c_mktsegment <> 'MACHINERY' then cast(round(abs(c_acctbal) * 100) as bigint) else 0 end as duration_ms
        from customer""",
    "job_list": f"""
        select {_RUN.format('o_orderkey')} as app_id, o_orderkey as "jobId", {_STAGE_NAME} as name,
            {_AT.format(_ORDER_MS)} as "submissionTime", {_AT.format(_END_MS)} as "completionTime"
        from orders""",
    "task_list": _TASKS,
    "stage_attempts": _STAGES,
    "run_report": f"""
        with s as ({_STAGES}), t as (select distinct * exclude ("executorDeserializeTime", failed, killed) from ({_TASKS})),
        tc as ({_TC_STAGE})
        select s.app_id, status, s."stageId", s."attemptId", "numTasks", "numActiveTasks", "numCompleteTasks", "numFailedTasks",
            "numKilledTasks", "submissionTime", "firstTaskLaunchedTime", "completionTime", name, "rddIds", "taskAttempt",
            "taskDuration", "taskExecutorId", "taskIndex", "taskLaunchTime", "taskId",
            round("tcMinStage", 6) as "tcMinStage", round("tcMinStage" / "numTasks", 6) as "tcMinTask"
        from s left join t on t."stageId" = s."stageId" and t."attemptId" = s."attemptId"
        left join tc on tc."stageId" = s."stageId" """,
    "tc_of_app": f"""
        select {_RUN.format('o_orderkey')} as app_id,
            round(coalesce(sum({_MINUTES.format(_AT.format(_ORDER_MS), _AT.format(_END_MS))})
                filter (o_orderpriority = '1-URGENT'), 0), 6) as tc_min
        from orders group by 1""",
    "tc_per_stage": f"""select app_id, "stageId", round("tcMinStage", 6) as "tcMinStage" from ({_TC_STAGE})""",
    "split_explode": """
        select page_id, cast(unnest(generate_series(0, len(a) - 1)) as integer) as pos, unnest(a) as part
        from (select page_id, string_split(url, '/') as a from pages)""",
    "max_array_width": "select max(len(string_split(text, ' ')))::integer as max_width from documents",
    "feature_matrix": """
        select l_extendedprice as label, l_quantity as feature0,
            case when l_returnflag <> 'R' then l_discount end as feature1,
            case when l_linestatus = 'F' then l_tax end as feature2
        from lineitem""",
    "run_table_cast": """
        select l_orderkey as "stageId", case when l_returnflag <> 'R' then l_shipdate end as "submissionTime",
            l_partkey || ',' || l_suppkey as "rddIds",
            case when l_returnflag <> 'A' then cast(l_extendedprice as float) end as "taskDuration",
            case when l_linestatus <> 'O' then cast(l_suppkey as integer) end as "taskExecutorId",
            l_linenumber as "taskIndex", l_returnflag <> 'A' as "durationKnown"
        from lineitem""",
    "elapsed_minutes": f"""
        select event_id, {_MINUTES.format("timestamp '2024-01-01'", 'ts')} as minutes from events""",
    "nested_explode": """
        select vec_id as "stageId", 0::integer as "taskAttempt", cast(unnest(embedding) as double) as "taskDuration",
            cast(generate_subscripts(embedding, 1) - 1 as integer) as "taskIndex"
        from embeddings""",
    "last_match": """
        select doc_id, list_filter(string_split(text, ' '), lambda x: x in ('The', 'De', 'La', 'Der'))[-1] as word
        from documents""",
    "row_id": """
        select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_id
        from orders""",
    "regex_all": """
        select page_id, cast(unnest(generate_series(0, len(a) - 1)) as integer) as pos, unnest(a) as href
        from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as a from pages)""",
    "log_checkpoint_times": f"""
        select log, event_id, 0::integer as pos, k as "tcMs" from ({_LOG}) where event_type = 'click' and k >= 10""",
    "first_match": f"""
        select log, arg_min('spark-' || event_id || 'x', (ts, event_id)) as app_id
        from ({_LOG}) where event_type = 'signup' group by 1""",
    "zip_matches": f"""
        with l as ({_LOG}),
        times as (
            select log, k as tc, row_number() over (partition by log order by ts, event_id) as n
            from l where event_type = 'click' and k >= 10),
        rdds as (
            select log, case when event_type = 'purchase' then event_id else k end as rdd,
                row_number() over (partition by log order by ts, event_id) as n
            from l where event_type in ('purchase', 'view'))
        select log, rdd as "rddId", arg_max(tc, n) as "tcMs" from times join rdds using (log, n) group by 1, 2""",
    "polyvander": """
        select l_orderkey, l_linenumber, l_partkey, 1.0::double as p0, l_quantity as p1,
            pow(l_quantity, 2) as p2, pow(l_quantity, 3) as p3
        from lineitem""",
    "drop_nan": """
        select event_id, case when event_type <> 'error' then value end as value
        from events where event_type <> 'view'""",
    "first_attempt": """
        select l_orderkey as "stageId", l_linenumber as "attemptId", l_partkey, l_suppkey, l_extendedprice
        from lineitem
        qualify row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""",
    "tc_per_task": """
        select l_orderkey as "stageId", l_linenumber as "taskIndex", l_partkey as "taskId",
            cast(floor(l_quantity) - 1 as integer) as "numTasks", o_totalprice as "tcMinStage",
            o_totalprice / nullif(floor(l_quantity) - 1, 0) as "tcMinTask"
        from lineitem left join (select * from orders where o_orderpriority = '1-URGENT') on o_orderkey = l_orderkey""",
    "row_invariant": """
        select count(*) as rows_before, count(*) as rows_after, true as same from lineitem""",
    "tc_by_rdd": """
        with t as (
            select l_orderkey, l_linenumber,
                case when l_partkey in (select s_suppkey from supplier) then l_partkey
                     when l_suppkey in (select s_suppkey from supplier) then l_suppkey end as "rddId"
            from lineitem)
        select l_orderkey, l_linenumber, "rddId", s_acctbal as "tcMs" from t left join supplier on s_suppkey = "rddId" """,
    "align_runs": _ALIGNED,
    "mean_across_runs": f"""
        select l_orderkey, round(({_ALL_QUANTITIES}) / 5, 6) as "meanQuantity" from ({_ALIGNED})""",
    "tc_matrix": f"""
        select "stageId", {', '.join(f'r{r}.tc as "tcMinStage' + ('"' if r == 1 else f'_{r}"') for r in RUNS)},
            round((r1.tc + r2.tc + r3.tc + r4.tc + r5.tc) / 5, 6) as "meanTcMinStage"
        from (select * from ({_STAGE_RUNS}) where run = 1) r1
        {' '.join(f'join (select * from ({_STAGE_RUNS}) where run = {r}) r{r} using ("stageId")' for r in RUNS[1:])}
        order by 1""",
    "distinct_pairs": "select distinct l_partkey, l_suppkey from lineitem",
    "first_distinct": "select distinct l_suppkey, l_linenumber from lineitem order by 1, 2 limit 10",
    "dedupe": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
        qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) = 1""",
    "app_runtime": """
        select cast(floor(epoch_us(max(ts)) / 1000000) - floor(epoch_us(min(ts)) / 1000000) as bigint) as runtime_s
        from events""",
    "run_runtimes": _RUNTIMES,
    "mean_runtime": f"select round(avg(runtime_s) / 60, 6) as mean_runtime_min from ({_RUNTIMES})",
    "net_runtime": f"""
        with tc as (
            select user_id, {_MONEY.format('value')} / 60 as tc_min from events where event_type = 'purchase' group by 1)
        select user_id, round(runtime_s / 60, 6) as runtime_min, round(coalesce(tc_min, 0), 6) as tc_min,
            round(runtime_s / 60 - coalesce(tc_min, 0), 6) as net_runtime_min
        from ({_RUNTIMES}) left join tc using (user_id)""",
    "sum_distinct_tc": f"""
        select {_MONEY.format('value')} / 1000 as tc_sum_seconds from (select distinct value from events)""",
    "sum_distinct_tc_by_rdd": f"""
        select {_MONEY.format('value')} / 1000 as tc_sum_seconds from (select distinct user_id, value from events)""",
    "median_by_group": """
        select l_suppkey, quantile_disc(l_quantity, 0.5) as "medianL_quantity",
            quantile_disc(l_extendedprice, 0.5) as "medianL_extendedprice"
        from lineitem group by 1""",
    "sum_of_medians": """
        select round(sum(q), 4) as "sumMedianL_quantity", round(sum(p), 4) as "sumMedianL_extendedprice" from (
            select quantile_disc(l_quantity, 0.5) as q, quantile_disc(l_extendedprice, 0.5) as p
            from lineitem group by l_suppkey)""",
    "profile": " union all ".join(
        f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean,
            round(stddev_samp({c}), 6) as stddev, min({c}) as min, quantile_disc({c}, 0.25) as p25,
            quantile_disc({c}, 0.5) as p50, quantile_disc({c}, 0.75) as p75, max({c}) as max from lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "task_quantile": """
        select l_suppkey, list_sort(list(l_extendedprice))[
            least(cast(floor(0.99::double * count(*)) as bigint), count(*) - 1) + 1] as quantile
        from lineitem group by 1""",
    "tw_tr_ratio": """
        with m as (
            select user_id, max(value) filter (event_type = 'purchase') as tw,
                max(value) filter (event_type = 'error') as tr
            from events group by 1)
        select round(avg(tw), 6) as tw_mean, round(avg(tr), 6) as tr_mean,
            round(quantile_cont(tw, 0.5), 6) as tw_median, round(quantile_cont(tr, 0.5), 6) as tr_median,
            round(quantile_cont(tw, 0.5) / avg(tr), 6) as ratio
        from m""",
    "mttr": """
        with n as (
            select user_id, event_type, epoch_us(ts) as t, min(case when event_type <> 'error' then epoch_us(ts) end)
                over (partition by user_id order by ts, event_id
                    rows between 1 following and unbounded following) as next
            from events)
        select user_id, sum(next - t) filter (event_type = 'error')::double
            / (1000 * count(next) filter (event_type = 'error')) as mttr_ms,
            count(next) filter (event_type = 'error') as recoveries
        from n group by 1""",
    "task_recovery": f"""
        with t as (
            select app_id, failed or killed as lost, "stageId", "taskIndex", "taskId",
                epoch_ms("taskLaunchTime") + "taskDuration" as t
            from ({_TASKS})),
        n as (
            select app_id, lost, t, min(case when not lost then t end) over (
                partition by "stageId", "taskIndex" order by t, "taskId"
                rows between 1 following and unbounded following) as next
            from t)
        select app_id, round(avg(next - t) filter (lost), 2) as mttr_ms, count(next) filter (lost) as recoveries
        from n group by 1""",
    "stage_progress": """
        select distinct o_orderdate as "submissionTime", cast(floor(o_totalprice) as bigint) as "numCompleteTasks",
            case when o_orderstatus = 'F' then 1 else 0 end::integer as "numFailedTasks"
        from orders""",
    "tc_over_time": """
        select distinct o_orderdate as "submissionTime", case when o_orderpriority = '1-URGENT' then o_totalprice end as "tcMs"
        from orders""",
    "compare_runs": f"""
        with tc as (select {_MONEY.format('l_quantity')} / 60 as tc_min from lineitem),
        r as (
            select case l_returnflag when 'N' then 'normal' else 'checkpoint' end as run, count(*) as tasks,
                cast(sum(l_linenumber) as bigint) as failed_tasks,
                (epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 1000000 / 60 as runtime_min
            from lineitem group by 1)
        select run, tasks, failed_tasks, round(runtime_min, 6) as runtime_min,
            round(case run when 'checkpoint' then tc_min else 0 end, 6) as tc_min,
            round(runtime_min - case run when 'checkpoint' then tc_min else 0 end, 6) as net_runtime_min
        from r cross join tc""",
    "out_degree": """
        select l_partkey as src, count(distinct l_suppkey) as degree from lineitem group by 1""",
    "pagerank": _PAGERANK,
    "pagerank_checkpoint": _PAGERANK,
    "pagerank_all_rounds": _PAGERANK_ALL,
    "kmeans_assign_many": """
        with x as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as v from embeddings),
        d as (
            select a.vec_id, b.vec_id as cluster, sum((a.v - b.v) * (a.v - b.v)) as distance
            from x a join x b using (i) where b.vec_id % 3 = 0 group by 1, 2)
        select vec_id, cluster, round(distance, 6) as distance from d
        qualify row_number() over (partition by vec_id order by distance, cluster) = 1""",
    "kmeans_checked": "select count(*) as n_points, 10::bigint as n_clusters, true as nearest, true as cost_adds_up from embeddings",
    "lda_topics_checked": """
        select cast(t as integer) as topic, 10::bigint as n_terms, true as falling, true as shares
        from unnest(generate_series(0, 3)) as u(t)""",
    "lda_term_sums": f"""
        select term, cast(n_tokens as double) as total from ({_VOCABULARY} order by n_tokens desc, term limit 10000)""",
    "lda_likelihood": f"""
        select (select count(*) from documents) as n_docs,
            (select cast(sum(n_tokens) as bigint) from ({_VOCABULARY} order by n_tokens desc, term limit 10000)) as n_tokens,
            true as above_uniform, true as above_one_topic""",
    "kmeans_assign": f"select vec_id, cluster, round(distance, 6) as distance from ({_NEAREST})",
    "kmeans_cost": f"select round(sum(distance), 6) as cost from ({_NEAREST})",
    "tokenize": f"""
        select doc_id, coalesce(string_agg(word, ' ' order by pos), '') as tokens
        from documents left join ({_WORDS}) using (doc_id) group by 1""",
    "stopword_filter": f"""
        select doc_id, coalesce(string_agg(word, ' ' order by pos), '') as tokens
        from documents left join ({_KEPT}) using (doc_id) group by 1""",
    "vocabulary": f"{_VOCABULARY} order by n_tokens desc, term limit 10000",
    "corpus_counts": f"""
        select (select count(*) from documents) as n_docs, (select count(*) from ({_KEPT})) as n_tokens,
            (select cast(sum(n_docs) as bigint) from ({_VOCABULARY} order by n_tokens desc, term limit 10000)) as n_pairs""",
    "split_by_key": """
        select o_orderkey, cast(case when o_orderkey % 100 < 50 then 0 when o_orderkey % 100 < 75 then 1 else 2 end
            as integer) as part
        from orders""",
    "rmse": "select round(sqrt(avg(pow(2 * l_quantity + 10 - l_extendedprice, 2))), 6) as rmse from lineitem",
    "string_index": """
        with i as (
            select event_type, (row_number() over (order by count(*) desc, event_type) - 1)::double as type_index
            from events group by 1)
        select event_id, event_type, type_index from events join i using (event_type)""",
    "one_hot": f"""
        with i as (
            select event_type, row_number() over (order by count(*) desc, event_type) - 1 as i from events group by 1)
        select event_id, {', '.join(f'(i = {p})::integer::double as p{p}' for p in range(4))}
        from events join i using (event_type)""",
    "impute": """
        select o_orderkey, round(case when o_orderstatus = 'O' then o_totalprice else
            (select avg(o_totalprice) from orders where o_orderstatus = 'O') end, 6) as price_imp
        from orders""",
    "min_max_scale": """
        select l_orderkey, l_linenumber, l_partkey,
            round((l_quantity - min(l_quantity) over ()) / (max(l_quantity) over () - min(l_quantity) over ()), 6) as scaled0,
            round((l_extendedprice - min(l_extendedprice) over ())
                / (max(l_extendedprice) over () - min(l_extendedprice) over ()), 6) as scaled1
        from lineitem""",
    "auc_roc": f"""{_CURVE},
        q as (select tp / all_p as y, fp / all_n as x,
            lag(tp / all_p, 1, 0) over (order by score desc) as y0, lag(fp / all_n, 1, 0) over (order by score desc) as x0
            from c)
        select round(sum((x - x0) * (y + y0) / 2), 6) as auc from q""",
    "auc_pr": f"""{_CURVE},
        q as (select tp / all_p as x, tp / (tp + fp) as y, lag(tp / all_p, 1, 0) over (order by score desc) as x0,
            lag(tp / (tp + fp), 1, tp / (tp + fp)) over (order by score desc) as y0 from c)
        select round(sum((x - x0) * (y + y0) / 2), 6) as auc from q""",
    "gen_polynomial": f"""
        select o_orderkey as id, round(2 * {_X} + 10 + 3.0::double * {_normal('o_orderkey', 'poly42', 'cos')}, 6) as label,
            1.0::double as f0, round({_X}, 6) as f1, round(pow({_X}, 2), 6) as f2, round(pow({_X}, 3), 6) as f3
        from orders""",
    "gen_clusters": f"""
        with d as (
            select o_orderkey as id, {_CLUSTER} as cluster, {_normal('o_orderkey', 'point42', 'cos')} as n0,
                {_normal('o_orderkey', 'point42', 'sin')} as n1
            from orders)
        select id, cluster, round({_uniform('cluster', 'centre42', 0)} + 0.012::double * n0, 6) as x0,
            round({_uniform('cluster', 'centre42', 1)} + 0.012::double * n1, 6) as x1
        from d""",
}
