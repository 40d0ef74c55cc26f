"""Every registered query as plain SQL (DuckDB) over the same tables.

The SQL makes the log lines from ``events`` again and parses them on its own;
it shares no code with the Spark side.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _lines(app: str) -> str:
    """CTEs up to ``lines(file_path, container, value, e, head, level)``."""
    task = "'task ' || e % 8 || '.0 in stage ' || e % 5 || '.0 (TID ' || e || ')'"
    attempt = "'task ' || e % 8 || '.' || e % 3 || ' in stage ' || e % 5 || '.0 (TID ' || e"
    return rf"""
    ev AS (
      SELECT event_id AS e, CAST(floor(value) AS BIGINT) AS s, event_type AS k,
        strftime(ts, '%y/%m/%d %H:%M:%S') AS t,
        strftime(ts + to_seconds(CAST(floor(value) AS BIGINT)), '%y/%m/%d %H:%M:%S') AS t_end,
        {app} AS a
      FROM events),
    named AS (
      SELECT *, CASE WHEN a % 10 < 7 THEN '1703980800000' WHEN a % 10 < 9 THEN '1700006400000'
        ELSE '1690243200000' END || '_' || printf('%04d', a) AS ids
      FROM ev),
    placed AS (
      SELECT *,
        CASE WHEN e % 97 = 0 THEN 'gateway' ELSE 'application_' || ids END AS app,
        CASE WHEN e % 97 = 0 THEN 'edge'
          ELSE 'container_' || ids || '_01_' || printf('%06d', e % 3 + 1) END AS container
      FROM named),
    raw AS (
      SELECT *, 1 AS ln, t || ' INFO executor.Executor: Running ' || {task} AS value FROM placed WHERE k = 'view'
      UNION ALL
      SELECT *, 2 AS ln, t_end || ' INFO executor.Executor: Finished ' || {task}
        || '. 1536 bytes result sent to driver' FROM placed WHERE k = 'view' AND e % 11 <> 0
      UNION ALL
      SELECT *, 3 AS ln, t || ' INFO rdd.HadoopRDD: Input split: hdfs://10.0.0.11:9000/in/part-' || e % 100
        || '.txt:' || e * 1000 || '+' || s * 1024 + e FROM placed WHERE k = 'click'
      UNION ALL
      SELECT *, 4 AS ln, t || ' INFO python.PythonRunner: Times: total = ' || s + e % 50 || ', boot = '
        || e % 300 - 150 || ', init = ' || e % 40 || ', finish = ' || s FROM placed WHERE k = 'click'
      UNION ALL
      SELECT *, 5 AS ln, t || ' INFO storage.BlockManager: Found block rdd_' || e % 20 || '_' || e % 4
        || CASE WHEN e % 3 = 0 THEN ' remotely' ELSE ' locally' END FROM placed WHERE k = 'click' AND e % 2 = 0
      UNION ALL
      SELECT *, 6 AS ln, t || ' INFO storage.MemoryStore: Block broadcast_' || e
        || ' stored as bytes in memory (estimated size ' || s || '.' || e % 10
        || CASE WHEN e % 13 = 0 THEN ' XB' WHEN e % 3 = 0 THEN ' KB' WHEN e % 3 = 1 THEN ' KiB' ELSE ' B' END
        || ', free ' || e % 500 || '.5 ' || CASE WHEN e % 2 = 0 THEN 'MB' ELSE 'MiB' END || ')'
      FROM placed WHERE k = 'purchase'
      UNION ALL
      SELECT *, 7 AS ln, t || ' INFO storage.MemoryStore: MemoryStore started with capacity ' || e % 7 + 1
        || '.5 ' || CASE WHEN e % 2 = 0 THEN 'GB' ELSE 'GiB' END FROM placed WHERE k = 'purchase' AND e % 3 = 0
      UNION ALL
      SELECT *, 50 AS ln, t || ' INFO broadcast.TorrentBroadcast: Started reading broadcast variable ' || e % 50
      FROM placed WHERE k = 'purchase' AND e % 4 = 0
      UNION ALL
      SELECT *, 8 AS ln, t || ' INFO YarnAllocator: Will request ' || e % 16 + 1
        || ' executor containers, each with ' || e % 5 + 1 || ' cores and ' || (e % 8 + 1) * 1024
        || ' MB memory including ' || (e % 8 + 1) * 128 || ' MB overhead' FROM placed WHERE k = 'signup'
      UNION ALL
      SELECT *, 9 AS ln, t || ' INFO YarnAllocator: Container request (host: Any, capability: <memory:'
        || (e % 8 + 1) * 1152 || ', vCores:' || e % 5 + 1 || '>)' FROM placed WHERE k = 'signup' AND e % 3 = 0
      UNION ALL
      SELECT *, 10 AS ln, t || ' WARN YarnAllocator no colon here' FROM placed WHERE k = 'signup' AND e % 4 = 0
      UNION ALL
      SELECT *, 11 AS ln, '17/13/45 10:04:42 WARN a.B: bad date' FROM placed WHERE k = 'signup' AND e % 6 = 1
      UNION ALL
      SELECT *, 12 AS ln, t || ' WARN scheduler.TaskSetManager: Lost ' || {attempt}
        || ', node-' || e % 6 || ', executor ' || e % 9 || '): reset' FROM placed WHERE k = 'error' AND e % 4 = 0
      UNION ALL
      SELECT *, 13 AS ln, t || ' ERROR executor.Executor: Exception in ' || {attempt} || ')' FROM placed WHERE k = 'error'
      UNION ALL
      SELECT *, 14 AS ln, chr(9) || 'at org.foo.INFORMATION(App.scala:' || e % 90 || ')' FROM placed WHERE k = 'error'
      UNION ALL
      SELECT *, 15 AS ln, '' FROM placed WHERE k = 'error' AND e % 5 = 0
      UNION ALL
      SELECT *, 16 AS ln, t || ' TERRORIZE x' FROM placed WHERE k = 'error' AND e % 7 = 0),
    lines AS (
      SELECT 'file:///logs/' || app || '/' || container || '.log' AS file_path, app, container, value, t, k, e, ln
      FROM raw),
    parsed AS (
      SELECT file_path, value,
        regexp_extract(value, '^(\d{{2}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}})', 1) AS stamp,
        regexp_extract(value, '(INFO|WARN|ERROR|DEBUG)', 1) AS log_level,
        regexp_extract(value, '(INFO|WARN|ERROR|DEBUG)\s+([^:]+):', 2) AS component,
        regexp_extract(file_path, '(application_\d+_\d+)', 1) AS application_id,
        regexp_extract(file_path, 'application_(\d+)_\d+', 1) AS cluster_id,
        regexp_extract(file_path, 'application_\d+_(\d+)', 1) AS app_number,
        regexp_extract(file_path, '(container_\d+_\d+_\d+_\d+)', 1) AS container_id
      FROM lines),
    timed AS (SELECT *, try_strptime(stamp, '%y/%m/%d %H:%M:%S') AS at_time FROM parsed)"""


APP = "user_id * 10 + (day(ts) - 1) // 3"
LINES = _lines(APP)
TREE = _lines(f"({APP}) % 40")
# one file per container; the last application's are empty
_FILES = """,
    files AS (
      SELECT application_id, container_id, CASE WHEN ends_with(application_id, '_0039') THEN 0
        ELSE sum(octet_length(encode(value)) + 1) END AS n_bytes
      FROM parsed GROUP BY file_path, application_id, container_id),
    per_app AS (
      SELECT application_id, count(*) AS n_files, count(*) FILTER (n_bytes = 0) AS n_empty_files, sum(n_bytes)::BIGINT AS n_bytes
      FROM files GROUP BY 1),
    inventory AS (
      SELECT count(*) FILTER (application_id <> '') AS n_applications, sum(n_files)::BIGINT AS n_files,
        sum(n_empty_files)::BIGINT AS n_empty_files, sum(n_bytes)::BIGINT AS n_bytes FROM per_app)"""
FILES = TREE + _FILES
ALL_FILES = LINES + _FILES
FEW_FILES = _lines(f"({APP}) % 2")
TIMELINE = LINES + """,
    timeline AS (
      SELECT cluster_id, application_id, app_number, min(at_time) AS start_time, max(at_time) AS end_time
      FROM timed GROUP BY ALL HAVING min(at_time) IS NOT NULL),
    apps AS (SELECT cluster_id, count(*) AS num_applications FROM timeline GROUP BY 1)"""
DURATIONS = TIMELINE + """,
    spans AS (
      SELECT cluster_id, application_id, date_diff('second', start_time, end_time) AS duration_sec
      FROM timeline),
    durations AS (
      SELECT * FROM spans WHERE cluster_id =
        (SELECT cluster_id FROM apps ORDER BY num_applications DESC, cluster_id LIMIT 1)),
    stats AS (
      SELECT min(duration_sec) AS lo, max(duration_sec) AS hi, count(*) AS total,
        sum(CAST(duration_sec AS HUGEINT)) AS s1,
        sum(CAST(duration_sec AS HUGEINT) * duration_sec) AS s2
      FROM durations)"""
TASKS = LINES + r""",
    steps AS (
      SELECT application_id, container_id, at_time,
        regexp_extract(value, '(Running|Finished) task \d+\.\d+ in stage', 1) AS step,
        regexp_extract(value, 'in stage (\d+\.\d+) \(TID', 1) AS stage,
        CAST(regexp_extract(value, 'TID (\d+)', 1) AS BIGINT) AS tid
      FROM timed
      WHERE regexp_matches(value, '(Running|Finished) task \d+\.\d+ in stage \d+\.\d+ \(TID \d+\)')),
    tasks AS (
      SELECT *, date_diff('second', started_at, finished_at) AS duration_sec FROM (
        SELECT application_id, container_id, stage, tid,
          min(at_time) FILTER (WHERE step = 'Running') AS started_at,
          max(at_time) FILTER (WHERE step = 'Finished') AS finished_at
        FROM steps GROUP BY ALL))"""


def _add(base: str | None = None, **sql: str) -> None:
    for name, text in sql.items():
        ORACLES[name] = f"WITH {base}\n{text}" if base else text


# the byte at which a line begins: the lines of a container are in the order of their events
PLACED = TREE + r""",
    placed_lines AS (
      SELECT 'app=' || app || '/container=' || container AS file, value, regexp_extract(value, '(INFO|WARN|ERROR|DEBUG)', 1) AS log_level,
        (sum(octet_length(encode(value)) + 1) OVER (PARTITION BY app, container ORDER BY e, ln ROWS UNBOUNDED PRECEDING)
          - octet_length(encode(value)) - 1)::BIGINT AS line_start
      FROM lines WHERE NOT ends_with(app, '_0039')),
    drawn AS (
      SELECT value AS log_entry, log_level FROM placed_lines WHERE log_level <> ''
      ORDER BY md5(file || ':' || line_start), file || ':' || line_start LIMIT 10)"""
_add(
    PLACED,
    scan_placed_lines="SELECT value, file, line_start FROM placed_lines",
    sample_log_entries="SELECT * FROM drawn",
    levels_with_sample="""
      SELECT log_entry, log_level, count AS n_lines, count
      FROM drawn JOIN (SELECT log_level, count(*) AS count FROM placed_lines GROUP BY 1) USING (log_level)""",
)
_add(
    FILES,
    top_apps_by_files="SELECT * FROM per_app WHERE application_id <> '' ORDER BY n_files DESC, 1 LIMIT 5",
    files_per_app="SELECT * FROM per_app",
    dataset_inventory="SELECT * FROM inventory",
    inventory_with_lines="SELECT *, (SELECT count(*) FROM parsed WHERE NOT ends_with(application_id, '_0039')) AS n_lines FROM inventory",
)
_add(
    ALL_FILES,
    containers_per_app="""
      SELECT application_id,
        CASE WHEN right(container_id, 6) = '000001' THEN 'application_master' ELSE 'executor' END AS role,
        count(*) AS n_containers FROM files WHERE container_id <> '' GROUP BY 1, 2""",
)
_add(
    TREE,
    scan_log_tree="SELECT value FROM lines",
    scan_log_glob="SELECT value FROM lines WHERE app <> 'gateway'",
    file_path_column="SELECT application_id, container_id, count(*) AS n_lines FROM parsed GROUP BY 1, 2",
)
_ENTRIES = r"""
      SELECT regexp_extract(container, '(container_\d+_\d+_\d+_\d+)', 1) AS container_id, value,
        value = '' OR value LIKE chr(9) || '%' AS is_continuation,
        CASE WHEN value LIKE '__/__/__ %' THEN value[1:17] ELSE t END AS entry_timestamp,
        CASE WHEN value LIKE '__/__/__ %' THEN regexp_extract(value, '(INFO|WARN|ERROR|DEBUG)', 1)
          ELSE 'ERROR' END AS entry_level
      FROM lines"""
_add(
    FEW_FILES,
    # k and t belong to the event, so a continuation line's head is known without line order;
    # a signup may hold a second head with an impossible date, which has no lines below it
    multiline_entries=_ENTRIES,
    multiline_entries_blocks=_ENTRIES,
)
_add(
    scan_parquet_many="""
      SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS yyyy FROM orders
      WHERE (year(o_orderdate) = 1995 AND month(o_orderdate) IN (1, 12))
         OR (year(o_orderdate) = 1997 AND month(o_orderdate) = 6)""",
    scan_parquet_glob="""
      SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS yyyy
      FROM orders WHERE year(o_orderdate) = 1996""",
    scan_month_range="""
      SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS yyyy
      FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 6""",
    range_source="""
      SELECT CAST(d AS DATE) AS order_day, count(o_orderkey) AS n_orders
      FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
      LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1""",
    range_even_double="SELECT o_orderkey * 2 AS doubled FROM orders WHERE o_orderkey % 2 = 0",
    sql_count="SELECT count(*) AS total FROM orders",
    source_health="""
      SELECT 'orders' AS source, true AS ok, count(*) AS n_rows, CAST(6 AS INTEGER) AS n_columns,
        CAST(NULL AS VARCHAR) AS error_class FROM orders
      UNION ALL SELECT 'lineitem', true, count(*), 11, NULL FROM lineitem
      UNION ALL SELECT 'documents', true, count(*), 5, NULL FROM documents
      UNION ALL SELECT 'no_such_table', false, NULL, NULL, 'PATH_NOT_FOUND'""",
    row_counts=" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}"
        for t in ("orders", "lineitem", "events", "documents")
    ),
    schema_rows=" UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{d}' AS data_type, "
        f"count({c}) AS n_values FROM lineitem"
        for i, (c, d) in enumerate([
            ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
            ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
            ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
            ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
        ], 1)
    ),
)
_add(
    LINES,
    parse_log_level="SELECT value, log_level FROM parsed",
    parse_log_record="SELECT stamp AS timestamp, log_level, component, value AS message FROM parsed",
    enrich_log_record="""
      SELECT at_time AS timestamp, log_level, component, value AS message, file_path,
        application_id, cluster_id, app_number FROM timed WHERE stamp <> ''""",
    parse_log_timestamp="""
      SELECT stamp AS timestamp_text, at_time AS event_time, stamp <> '' AND at_time IS NULL AS rejected FROM timed""",
    timestamp_rejects="""
      SELECT count(*) FILTER (WHERE stamp <> '') AS n_stamped,
        count(*) FILTER (WHERE stamp <> '' AND at_time IS NULL) AS n_rejected FROM timed""",
    parse_path_ids="SELECT DISTINCT file_path, application_id, cluster_id, app_number FROM parsed",
    parse_container_id="SELECT DISTINCT file_path, container_id FROM parsed",
    container_role="""
      SELECT DISTINCT container_id, CASE WHEN container_id = '' THEN ''
        WHEN container_id LIKE '%\\_000001' ESCAPE '\\' THEN 'application_master'
        ELSE 'executor' END AS role FROM parsed""".replace("\\\\", "\\"),
    cluster_start_time="""
      SELECT DISTINCT cluster_id, epoch_ms(CAST(cluster_id AS BIGINT)) AS started_at
      FROM parsed WHERE cluster_id <> ''""",
    filter_has_level="SELECT value, file_path, log_level FROM parsed WHERE log_level <> ''",
    filter_has_timestamp="SELECT value, file_path FROM parsed WHERE stamp <> ''",
    filter_error_lines="SELECT value, file_path FROM parsed WHERE contains(value, 'ERROR')",
    log_level_counts="SELECT log_level, count(*) AS count FROM parsed WHERE log_level <> '' GROUP BY 1",
    log_level_counts_strict=r"""
      SELECT regexp_extract(value,
        '^\d\d/\d\d/\d\d \d\d:\d\d:\d\d\s+(INFO|WARN|ERROR|DEBUG)(?:\s|$)', 1) AS log_level,
        count(*) AS count FROM parsed GROUP BY 1 HAVING log_level <> ''""",
    log_totals="""
      SELECT count(*) AS total_lines, count(*) FILTER (WHERE log_level <> '') AS lines_with_level,
        count(DISTINCT nullif(log_level, '')) AS unique_levels FROM parsed""",
    log_level_distribution="""
      SELECT log_level, count(*) AS count, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage
      FROM parsed WHERE log_level <> '' GROUP BY 1""",
    level_counts_complete="""
      SELECT l AS log_level, (SELECT count(*) FROM parsed p WHERE p.log_level = l) AS count
      FROM (VALUES ('INFO'), ('WARN'), ('ERROR'), ('DEBUG')) known(l)""",
    level_token_counts="""
      SELECT token, count(*) AS count FROM (
        SELECT unnest(regexp_extract_all(value, '(INFO|WARN|ERROR|DEBUG)', 1)) AS token FROM parsed)
      GROUP BY 1""",
    sample_by_text="""
      , c AS (SELECT left(md5(file_path || chr(10) || value), 16) AS digest, count(*) AS copies,
          min(value) AS value, min(log_level) AS log_level FROM parsed WHERE log_level <> '' GROUP BY 1),
      n AS (SELECT digest, copies, unnest(range(1, least(10, copies) + 1)) AS i FROM c),
      p AS (SELECT digest, sum(-ln((CAST('0x' || left(md5(digest || chr(10) || i), 12) AS BIGINT) + 1)::DOUBLE
          / 281474976710656::DOUBLE) / (copies - i + 1)) OVER (PARTITION BY digest ORDER BY i) AS place FROM n),
      best AS (SELECT digest FROM p ORDER BY place, digest LIMIT 10)
      SELECT value AS log_entry, log_level FROM best JOIN c USING (digest)""",
    sample_random="""
      SELECT least(10, count(*)) AS n_places, least(10, count(*)) AS n_known FROM parsed WHERE log_level <> ''""",
    write_totals="""
      , n AS (SELECT log_level, count(*) AS count FROM parsed GROUP BY 1)
      SELECT log_level, count, (SELECT sum(count) FROM n)::BIGINT AS total_lines,
        (SELECT sum(count) FROM n WHERE log_level <> '')::BIGINT AS lines_with_level, (SELECT count(*) FROM n) AS n_rows
      FROM n WHERE log_level <> ''""",
    component_counts="SELECT component, count(*) AS count FROM parsed GROUP BY 1",
    top_components="""
      SELECT component, count(*) AS count FROM parsed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20""",
    report_log_levels="""
      , n AS (SELECT log_level, count(*) AS c FROM parsed GROUP BY 1),
      v AS (SELECT sum(c)::BIGINT AS valid, count(*) AS levels FROM n WHERE log_level <> ''),
      f AS (SELECT CAST(1 AS INTEGER) AS line_no,
          'Total log lines processed: ' || format('{:,}', (SELECT sum(c)::BIGINT FROM n)) AS line
        UNION ALL SELECT 2, 'Total lines with log levels: ' || format('{:,}', valid) FROM v
        UNION ALL SELECT 3, 'Unique log levels found: ' || levels FROM v
        UNION ALL SELECT 4, '' UNION ALL SELECT 5, 'Log level distribution:'
        UNION ALL SELECT CAST(5 + row_number() OVER (ORDER BY c DESC, log_level) AS INTEGER),
          '  ' || rpad(log_level, 5, ' ') || ': ' || lpad(format('{:,}', c), 10, ' ')
            || ' (' || printf('%6.2f', c * 100.0::DOUBLE / valid) || '%)'
        FROM n, v WHERE log_level <> '')
      SELECT * FROM f""",
    resource_requests=r"""
      , r AS (SELECT application_id,
          CAST(regexp_extract(value, 'request (\d+) executor', 1) AS BIGINT) AS n,
          CAST(regexp_extract(value, 'with (\d+) cores', 1) AS BIGINT) AS c,
          CAST(regexp_extract(value, '(\d+) MB memory', 1) AS BIGINT) AS m,
          CAST(regexp_extract(value, '(\d+) MB overhead', 1) AS BIGINT) AS o
        FROM parsed WHERE value LIKE '%Will request %')
      SELECT application_id, count(*) AS n_requests, sum(n)::BIGINT AS executors,
        sum(n * c)::BIGINT AS total_cores, sum(n * m)::BIGINT AS total_memory_mb,
        sum(n * o)::BIGINT AS total_overhead_mb FROM r GROUP BY 1""",
    python_times=r"""
      SELECT CAST(regexp_extract(value, 'total = (-?\d+)', 1) AS BIGINT) AS total_ms,
        CAST(regexp_extract(value, 'boot = (-?\d+)', 1) AS BIGINT) AS boot_ms,
        CAST(regexp_extract(value, 'init = (-?\d+)', 1) AS BIGINT) AS init_ms,
        CAST(regexp_extract(value, 'finish = (-?\d+)', 1) AS BIGINT) AS finish_ms, application_id
      FROM parsed WHERE component = 'python.PythonRunner'""",
    input_bytes=r"""
      SELECT application_id, count(*) AS n_splits,
        sum(CAST(regexp_extract(value, '\+(\d+)$', 1) AS BIGINT))::BIGINT AS input_bytes
      FROM parsed WHERE component = 'rdd.HadoopRDD' GROUP BY 1""",
    block_memory=r"""
      , a AS (SELECT application_id, value LIKE '%in memory%' AS block,
          regexp_extract(value, 'size ([\d.]+) (\w+)', ['n', 'u']) AS size,
          regexp_extract(value, 'free ([\d.]+) (\w+)', ['n', 'u']) AS free,
          regexp_extract(value, 'capacity ([\d.]+) (\w+)', ['n', 'u']) AS capacity
        FROM parsed WHERE component = 'storage.MemoryStore'),
      f AS (SELECT * FROM (VALUES ('B', 1), ('KB', 1024), ('KiB', 1024), ('MB', 1048576), ('MiB', 1048576),
          ('GB', 1073741824), ('GiB', 1073741824)) t(u, x)),
      m AS (SELECT application_id, block,
          CAST(round(CAST(nullif(size.n, '') AS DECIMAL(18, 4)) * fs.x) AS BIGINT) AS stored,
          CAST(round(CAST(nullif(free.n, '') AS DECIMAL(18, 4)) * ff.x) AS BIGINT) AS free,
          CAST(round(CAST(nullif(capacity.n, '') AS DECIMAL(18, 4)) * fc.x) AS BIGINT) AS capacity
        FROM a LEFT JOIN f fs ON fs.u = size.u LEFT JOIN f ff ON ff.u = free.u LEFT JOIN f fc ON fc.u = capacity.u)
      SELECT application_id, count(*) FILTER (WHERE block) AS n_blocks, sum(stored)::BIGINT AS stored_bytes,
        min(free) AS min_free_bytes, max(capacity) AS max_capacity_bytes,
        count(*) FILTER (WHERE CASE WHEN block THEN stored IS NULL OR free IS NULL ELSE capacity IS NULL END) AS n_unread
      FROM m GROUP BY 1""",
    cache_use=r"""
      SELECT application_id, count(*) FILTER (WHERE value LIKE '% locally') AS n_local,
        count(*) FILTER (WHERE value LIKE '% remotely') AS n_remote,
        count(DISTINCT regexp_extract(value, '(rdd_\d+_\d+)', 1)) AS n_blocks
      FROM parsed WHERE component = 'storage.BlockManager' GROUP BY 1""",
    container_requests=r"""
      SELECT application_id, regexp_extract(value, 'host: (\w+)', 1) AS host,
        CAST(regexp_extract(value, 'memory:(\d+)', 1) AS BIGINT) AS memory_mb,
        CAST(regexp_extract(value, 'vCores:(\d+)', 1) AS BIGINT) AS v_cores, count(*) AS n_containers
      FROM parsed WHERE value LIKE '%Container request %' GROUP BY 1, 2, 3, 4""",
    failed_tasks=r"""
      , x AS (SELECT application_id, at_time,
          CAST(regexp_extract(value, 'task (\d+)\.', 1) AS BIGINT) AS task,
          CAST(regexp_extract(value, 'task \d+\.(\d+)', 1) AS BIGINT) AS attempt,
          regexp_extract(value, 'stage (\d+\.\d+)', 1) AS stage,
          CAST(regexp_extract(value, 'TID (\d+)', 1) AS BIGINT) AS tid
        FROM timed WHERE value LIKE '%Exception in task %' OR value LIKE '%Lost task %')
      SELECT application_id, stage, task, count(DISTINCT (attempt, tid)) AS n_failures,
        min(attempt) AS first_attempt, max(attempt) AS last_attempt,
        min(at_time) AS first_failed_at, max(at_time) AS last_failed_at FROM x GROUP BY 1, 2, 3""",
    failures_by_app="""
      SELECT application_id, component, count(*) AS n_errors FROM parsed
      WHERE log_level = 'ERROR' GROUP BY 1, 2""",
)
ORACLES["csv_round_trip"] = f"""WITH {LINES}
    SELECT value, ' "' || value || '",' || chr(9) || 'said it, ' || file_path || chr(92) AS noted FROM lines"""
_add(
    TIMELINE,
    app_timeline="SELECT * FROM timeline",
    cluster_summary="""
      SELECT cluster_id, count(DISTINCT application_id) AS num_applications,
        min(start_time) AS cluster_first_app, max(end_time) AS cluster_last_app FROM timeline GROUP BY 1""",
    usage_totals="""
      SELECT count(DISTINCT cluster_id) AS total_clusters, count(*) AS total_applications,
        count(*)::DOUBLE / count(DISTINCT cluster_id) AS avg_apps_per_cluster FROM timeline""",
    top_clusters="SELECT * FROM apps ORDER BY num_applications DESC, cluster_id LIMIT 5",
    largest_cluster="SELECT * FROM apps ORDER BY num_applications DESC, cluster_id LIMIT 1",
    largest_cluster_apps="""
      SELECT * FROM timeline WHERE cluster_id =
        (SELECT cluster_id FROM apps ORDER BY num_applications DESC, cluster_id LIMIT 1)""",
    cluster_share="""
      SELECT *, num_applications * 100.0::DOUBLE / (SELECT count(*) FROM timeline) AS percentage FROM apps""",
    apps_per_cluster_bars="""
      SELECT cluster_id, num_applications, CAST(num_applications AS VARCHAR) AS label FROM apps""",
    reload_saved_results="""
      SELECT cluster_id, num_applications, CAST(num_applications AS VARCHAR) AS label FROM apps""",
    app_concurrency="""
      , change AS (
        SELECT cluster_id, start_time AS at_time, 1 AS up, 0 AS down FROM timeline
        UNION ALL SELECT cluster_id, end_time, 0, 1 FROM timeline),
      by_second AS (
        SELECT cluster_id, at_time, sum(up)::BIGINT AS started, sum(down)::BIGINT AS ended
        FROM change GROUP BY 1, 2),
      total AS (
        SELECT *, (sum(started - ended) OVER (PARTITION BY cluster_id ORDER BY at_time))::BIGINT AS running
        FROM by_second)
      SELECT cluster_id, at_time, started, ended, running - started AS running_before_starts, running FROM total""",
    report_cluster_usage="""
      , t AS (SELECT count(*) AS c, sum(num_applications)::BIGINT AS a FROM apps),
      f AS (SELECT CAST(1 AS INTEGER) AS line_no, 'Total unique clusters: ' || format('{:,}', c) AS line FROM t
        UNION ALL SELECT 2, 'Total applications: ' || format('{:,}', a) FROM t
        UNION ALL SELECT 3, 'Average applications per cluster: ' || printf('%.2f', a::DOUBLE / c) FROM t
        UNION ALL SELECT 4, '' UNION ALL SELECT 5, 'Most heavily used clusters:'
        UNION ALL SELECT CAST(5 + r AS INTEGER),
          '  Cluster ' || cluster_id || ': ' || num_applications || ' applications'
        FROM (SELECT *, row_number() OVER (ORDER BY num_applications DESC, cluster_id) AS r FROM apps)
        WHERE r <= 5)
      SELECT * FROM f""",
)
_HISTOGRAM = """
      , binned AS (
        SELECT least((duration_sec - lo) * 30 // (hi - lo) + 1, 30) AS bin, count(*) AS n
        FROM durations, stats GROUP BY 1),
      edges AS (
        SELECT b AS bin, lo + (b - 1) * ((hi - lo)::DOUBLE / 30) AS bin_start,
          lo + b * ((hi - lo)::DOUBLE / 30) AS bin_end, (hi - lo)::DOUBLE / 30 AS width, total
        FROM range(1, 31) g(b), stats),
      hist AS (
        SELECT bin, bin_start, bin_end, coalesce(n, 0) AS count, coalesce(n, 0) / (total * width) AS density
        FROM edges LEFT JOIN binned USING (bin))"""
_BY_CLUSTER = """
      , per AS (SELECT cluster_id, min(duration_sec) AS lo, max(duration_sec) AS hi, count(*) AS total,
          sum(CAST(duration_sec AS HUGEINT)) AS s1, sum(CAST(duration_sec AS HUGEINT) * duration_sec) AS s2
        FROM spans GROUP BY 1)"""
_add(
    DURATIONS,
    app_durations="SELECT * FROM durations",
    duration_histogram=_HISTOGRAM + " SELECT * FROM hist",
    duration_histogram_log=_HISTOGRAM + """
      SELECT bin, CASE WHEN bin_start > 0 THEN round(log10(bin_start), 9) END AS log_bin_start,
        CASE WHEN bin_end > 0 THEN round(log10(bin_end), 9) END AS log_bin_end, count FROM hist""",
    duration_density="""
      , band AS (
        SELECT lo, hi - lo AS span, total::DOUBLE AS total,
          sqrt((s2::DOUBLE - s1::DOUBLE * s1::DOUBLE / total) / (total - 1)) * pow(total::DOUBLE, -0.2) AS h
        FROM stats),
      grid AS (
        SELECT CAST(g AS INTEGER) AS point, lo + g * span / 199::DOUBLE AS x, total, h
        FROM range(0, 200) r(g), band)
      SELECT point, x, round(sum(exp(-0.5::DOUBLE * pow((x - duration_sec) / h, 2))
        / (total * h * sqrt(2 * pi()))), 12) AS density
      FROM grid, durations GROUP BY 1, 2""",
    duration_density_binned="""
      , band AS (
        SELECT lo, hi - lo AS span, total::DOUBLE AS total,
          sqrt((s2::DOUBLE - s1::DOUBLE * s1::DOUBLE / total) / (total - 1)) * pow(total::DOUBLE, -0.2) AS h
        FROM stats),
      cells AS (
        SELECT ((duration_sec - lo) * 3184) // span AS node, ((duration_sec - lo) * 3184) % span AS rest, span FROM durations, band),
      nodes AS (
        SELECT node, sum(w)::DOUBLE / any_value(span) AS weight
        FROM (SELECT node, span - rest AS w, span FROM cells UNION ALL SELECT node + 1, rest, span FROM cells) GROUP BY node)
      SELECT CAST(g AS INTEGER) AS point, lo + g * span / 199::DOUBLE AS x,
        round(sum(weight * exp(-0.5::DOUBLE * pow((g * 16 - node) * span / 3184::DOUBLE / h, 2)) / (total * h * sqrt(2 * pi()))), 12) AS density
      FROM nodes, range(0, 200) r(g), band GROUP BY g, lo, span""",
    app_duration_stats="""
      SELECT cluster_id, count(*) AS n, min(duration_sec) AS min_sec,
        quantile_disc(duration_sec, 0.5) AS median_sec, max(duration_sec) AS max_sec,
        round(avg(duration_sec), 6) AS mean_sec, round(stddev_samp(duration_sec), 6) AS stddev_sec
      FROM durations GROUP BY 1""",
    duration_cdf="""
      SELECT duration_sec, n, (sum(n) OVER (ORDER BY duration_sec))::BIGINT AS cumulative,
        (sum(n) OVER (ORDER BY duration_sec))::DOUBLE / (SELECT total FROM stats) AS share
      FROM (SELECT duration_sec, count(*) AS n FROM durations GROUP BY 1)""",
    duration_outliers="""
      SELECT cluster_id, application_id, duration_sec, median_sec FROM spans
      JOIN (SELECT cluster_id, quantile_disc(duration_sec, 0.5) AS median_sec FROM spans GROUP BY 1)
      USING (cluster_id) WHERE duration_sec > 1.05::DOUBLE * median_sec""",
    duration_histogram_by_cluster=_BY_CLUSTER + """,
      binned AS (
        SELECT cluster_id, CASE WHEN hi = lo THEN 1 ELSE least((duration_sec - lo) * 30 // (hi - lo) + 1, 30) END AS bin,
          count(*) AS n FROM spans JOIN per USING (cluster_id) GROUP BY 1, 2)
      SELECT cluster_id, b AS bin, CASE WHEN hi > lo THEN lo + (b - 1) * ((hi - lo)::DOUBLE / 30) ELSE lo::DOUBLE END AS bin_start,
        CASE WHEN hi > lo THEN lo + b * ((hi - lo)::DOUBLE / 30) ELSE hi::DOUBLE END AS bin_end,
        coalesce(n, 0) AS count, CASE WHEN hi > lo THEN coalesce(n, 0) / (total * ((hi - lo)::DOUBLE / 30)) END AS density
      FROM (SELECT per.*, b, b AS bin FROM per, range(1, 31) g(b) WHERE hi > lo OR b = 1) LEFT JOIN binned USING (cluster_id, bin)""",
    duration_density_by_cluster=_BY_CLUSTER + """,
      band AS (
        SELECT cluster_id, lo, hi - lo AS span, total::DOUBLE AS total,
          sqrt((s2::DOUBLE - s1::DOUBLE * s1::DOUBLE / total) / (total - 1)) * pow(total::DOUBLE, -0.2) AS h
        FROM per WHERE total > 1 AND hi > lo),
      grid AS (SELECT cluster_id, CAST(g AS INTEGER) AS point, lo + g * span / 199::DOUBLE AS x, total, h
        FROM range(0, 200) r(g), band)
      SELECT cluster_id, point, x, round(sum(exp(-0.5::DOUBLE * pow((x - duration_sec) / h, 2))
        / (total * h * sqrt(2 * pi()))), 12) AS density
      FROM grid JOIN spans USING (cluster_id) GROUP BY 1, 2, 3""",
    duration_cdf_by_cluster="""
      SELECT cluster_id, duration_sec, n, (sum(n) OVER w)::BIGINT AS cumulative,
        (sum(n) OVER w)::DOUBLE / (sum(n) OVER (PARTITION BY cluster_id)) AS share
      FROM (SELECT cluster_id, duration_sec, count(*) AS n FROM spans GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY cluster_id ORDER BY duration_sec)""",
)
_add(
    TASKS,
    task_durations="SELECT * FROM tasks",
    task_time_by_app="""
      SELECT application_id, count(*) AS n_tasks, sum(duration_sec)::BIGINT AS total_sec,
        sum(duration_sec)::DOUBLE / count(*) AS mean_sec
      FROM tasks WHERE duration_sec IS NOT NULL GROUP BY 1""",
    unfinished_tasks="""
      SELECT application_id, container_id, stage, tid, started_at FROM tasks
      WHERE started_at IS NOT NULL AND finished_at IS NULL""",
    task_skew="""
      , s AS (SELECT application_id, stage, count(*) AS n_tasks, max(duration_sec) AS max_sec,
          quantile_disc(duration_sec, 0.5) AS median_sec
        FROM tasks WHERE duration_sec IS NOT NULL GROUP BY 1, 2)
      SELECT *, CASE WHEN median_sec <> 0 THEN max_sec::DOUBLE / median_sec END AS skew FROM s""",
)
_PARTS = """CAST(year(l_shipdate) AS INTEGER) AS dt_year, CAST(month(l_shipdate) AS INTEGER) AS dt_month,
        CAST(day(l_shipdate) AS INTEGER) AS dt_day"""
_DAILY = f"""
      SELECT {_PARTS}, count(*) AS num_trips, round(avg(l_quantity), 6) AS mean_trip_distance,
        max(l_tax) AS max_mta_tax, quantile_disc(l_extendedprice, 0.95) AS q95_fare_amount,
        min(l_discount) AS min_tip_amount, CAST(ceil(avg(l_linenumber)) AS BIGINT) AS mean_passenger_count
      FROM lineitem"""
_P95 = f"SELECT {_PARTS}, quantile_disc(l_extendedprice, 0.95) AS q95 FROM lineitem GROUP BY ALL"
_add(
    filter_year="SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE year(o_orderdate) = 1996",
    date_parts="""
      SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS dt_year,
        CAST(month(o_orderdate) AS INTEGER) AS dt_month, CAST(day(o_orderdate) AS INTEGER) AS dt_day
      FROM orders""",
    daily_summary=_DAILY + " WHERE year(l_shipdate) = 1996 GROUP BY ALL",
    daily_latest=_DAILY + " GROUP BY ALL ORDER BY dt_year DESC, dt_month DESC, dt_day DESC LIMIT 20",
    daily_p95_approx=_P95,
    daily_p95_exact=_P95,
    daily_rollup_totals="""
      SELECT count(*) AS n_days, sum(n)::BIGINT AS total_trips, sum(n)::DOUBLE / count(*) AS mean_daily_trips,
        min(d) AS first_date, max(d) AS last_date
      FROM (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem
            WHERE year(l_shipdate) = 1996 GROUP BY 1)""",
    report_daily="""
      WITH d AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n, avg(l_quantity) AS q, max(l_tax) AS t,
          quantile_disc(l_extendedprice, 0.95) AS f, min(l_discount) AS p,
          CAST(ceil(avg(l_linenumber)) AS BIGINT) AS c,
          row_number() OVER (ORDER BY CAST(l_shipdate AS DATE) DESC) AS r
        FROM lineitem GROUP BY CAST(l_shipdate AS DATE)),
      blocks AS (SELECT r, unnest([
          strftime(d, 'Year: %Y, Month: %m, Day: %d'),
          '  Trips: ' || format('{:,}', n),
          '  Avg Distance: ' || printf('%.2f', q) || ' miles',
          '  Max MTA Tax: $' || printf('%.2f', t),
          '  95th Percentile Fare: $' || printf('%.2f', f),
          '  Min Tip: $' || printf('%.2f', p),
          '  Avg Passengers: ' || c,
          repeat('-', 40)]) AS line, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS i FROM d WHERE r <= 5)
      SELECT CAST((r - 1) * 8 + i AS INTEGER) AS line_no, line FROM blocks""",
)
# A WITH list that a query extends.
ORACLES.update({
    k: v.replace("\n\n      ,", ",").replace("\n      ,", ",", 1)
    for k, v in ORACLES.items()
})

_ORDER_DAYS = """
      SELECT year(d)::INT AS dt_year, month(d)::INT AS dt_month, day(d)::INT AS dt_day, count(*) AS num_trips,
        round(avg(p), 7) AS mean_trip_distance, max(p) AS max_mta_tax, quantile_disc(p, 0.95) AS q95_fare_amount,
        min(p) AS min_tip_amount, CAST(ceil(avg(c)) AS BIGINT) AS mean_passenger_count
      FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, o_custkey AS c FROM orders) GROUP BY d"""
_add(
    rollup_daily_summary=_ORDER_DAYS,
    daily_latest_by_month=_ORDER_DAYS + " ORDER BY dt_year DESC, dt_month DESC, dt_day DESC LIMIT 20",
    rollup_daily_totals="""
      SELECT count(*) AS n_days, sum(n)::BIGINT AS total_trips, sum(n)::DOUBLE / count(*) AS mean_daily_trips,
        min(d) AS first_date, max(d) AS last_date
      FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)""",
)
_ROLLED = TREE + """,
    spoken AS (SELECT * FROM timed WHERE NOT ends_with(application_id, '_0039')),
    clusters AS (
      SELECT cluster_id, count(DISTINCT application_id) FILTER (at_time IS NOT NULL) AS num_applications, count(*) AS n_lines,
        min(at_time) AS cluster_first_app, max(at_time) AS cluster_last_app
      FROM spoken GROUP BY 1)"""
_add(
    _ROLLED,
    rollup_cluster_summary="SELECT * FROM clusters",
    rollup_usage_totals="""
      SELECT count(*) AS total_clusters, sum(num_applications)::BIGINT AS total_applications,
        sum(num_applications)::DOUBLE / count(*) AS avg_apps_per_cluster FROM clusters""",
)

_add(
    TIMELINE,
    sql_app_timeline="SELECT * FROM timeline WHERE cluster_id = '1700006400000'",
    sql_cluster_usage="""
      SELECT cluster_id, count(*) AS num_applications, max(end_time) AS last_end FROM timeline GROUP BY 1 HAVING count(*) >= 2""",
)
ORACLES["sql_level_counts"] = ORACLES["log_level_counts_strict"]


def _union(keys: str) -> str:
    """Gaps between islands of finished tasks of a group, and the most that ran at once."""
    on = " AND ".join(f"r.{k} = g.{k}" for k in keys.split(", "))
    return f"""
      , f AS (SELECT {keys}, started_at AS s, finished_at AS f FROM tasks WHERE finished_at >= started_at),
      g AS (SELECT *, coalesce(greatest(0, date_diff('second', max(f) OVER (PARTITION BY {keys} ORDER BY s, f
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)), 0) AS gap FROM f),
      c AS (SELECT {keys}, at_time, sum(d) AS d FROM (
          SELECT {keys}, s AS at_time, 1 AS d FROM f UNION ALL SELECT {keys}, f, -1 FROM f) GROUP BY ALL),
      r AS (SELECT {keys}, max(n)::BIGINT AS most_running FROM (
          SELECT {keys}, sum(d) OVER (PARTITION BY {keys} ORDER BY at_time) AS n FROM c) GROUP BY ALL),
      u AS (SELECT {keys}, min(s) AS first_start, max(f) AS last_end, count(*) AS n_spans,
          (date_diff('second', min(s), max(f)) - sum(gap))::BIGINT AS busy_sec, sum(gap)::BIGINT AS idle_sec,
          max(gap)::BIGINT AS longest_gap_sec FROM g GROUP BY ALL)
      SELECT g.*, r.most_running FROM u g JOIN r ON {on}"""


_add(
    TASKS,
    container_busy=_union("application_id, container_id").replace(
        "r.most_running FROM u", "r.most_running, busy_sec::DOUBLE / nullif(busy_sec + idle_sec, 0) AS busy_share FROM u"
    ),
    stage_timeline=_union("application_id, stage"),
)


def _templates(keys: str, count: str, condition: str, start: str) -> str:
    return rf"""
      , m AS (SELECT {keys}, list_transform(string_split_regex(trim(regexp_replace(value, '{start}', '')), '\s+'),
          lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS words FROM parsed WHERE {condition}),
      w AS (SELECT DISTINCT component, len(words) AS size, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM m),
      v AS (SELECT component, size, list(place) AS varying FROM (
          SELECT component, size, place FROM w GROUP BY ALL HAVING count(*) > 8) GROUP BY ALL)
      SELECT {keys}, array_to_string(list_transform(words,
          lambda x, i: CASE WHEN list_contains(coalesce(varying, []), i) THEN '<*>' ELSE x END), ' ') AS template, count(*) AS {count}
      FROM m LEFT JOIN v ON m.component = v.component AND len(words) = v.size GROUP BY ALL""".replace("SELECT component, array", "SELECT m.component, array").replace(
        "SELECT application_id, component, array", "SELECT application_id, m.component, array")


_add(
    LINES,
    failure_templates=_templates("application_id, component", "n_errors", "log_level = 'ERROR'", r"^.*?ERROR\s+[^:]*:"),
    line_templates=_templates("component", "n_lines", "component <> ''", r"^.*?(INFO|WARN|ERROR|DEBUG)\s+[^:]+:"),
    broadcast_reads=r"""
      SELECT application_id, count(*) AS n_reads, count(DISTINCT regexp_extract(value, 'broadcast variable (\d+)', 1)) AS n_variables
      FROM parsed WHERE value LIKE '%Started reading broadcast variable%' GROUP BY 1""",
)
