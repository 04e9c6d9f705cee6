"""The same results in SQL on the given tables, written independently of the library."""

from __future__ import annotations

from checks.fixtures import RUN_MILLIS, TRASH
from stowage.functions.categories import CATEGORIES, EXTENSIONS

ORACLE: dict[str, str] = {}

# ---- views as common table expressions ----

EXT = "ext(extension, category) AS (VALUES " + ", ".join(
    f"('.{e}', '{c}')" for c, listed in EXTENSIONS.items() for e in listed.split()
) + ")"

DOC_PATH = """concat('/data/', lang, '/s', doc_id % 20, '/b', doc_id // 240, '/doc_', doc_id % 48,
    CASE WHEN doc_id % 7 = 0 THEN '_1' ELSE '' END,
    (['.pdf','.JPG','.mp4','.mp3','.exe','.zip','.py','.xyz','','.tar.gz',
      '.txt','.png','.json','.mkv','.TXT','.'])[doc_id % 16 + 1])"""

TIMES = """TIMESTAMP '2024-01-01 00:00:00' + to_seconds((doc_id * 7919) % 86400) AS file_created_at,
    TIMESTAMP '2024-01-02 00:00:00' + to_seconds((doc_id * 104729) % 86400) AS file_modified_at"""

F_VIEW = f"""f AS (SELECT lang AS scan_id, {DOC_PATH} AS file_path, sha256(text) AS hash,
    CAST(strlen(text) AS BIGINT) AS size, {TIMES} FROM documents)"""


def name_of(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def ext_of(name: str) -> str:
    return f"regexp_extract({name}, '^.+(\\.[^.]*)$', 1)"


M_VIEW = f"""{EXT}, {F_VIEW},
n AS (SELECT *, {name_of('file_path')} AS file_name, lower({ext_of(name_of('file_path'))}) AS extension FROM f),
m AS (SELECT scan_id, file_name, file_path, file_path AS original_path, hash, n.extension,
    coalesce(category, 'Others') AS category, size, file_created_at, file_modified_at
  FROM n LEFT JOIN ext ON n.extension = ext.extension)"""

WALK = "string_split(file_path, '/')"
ORDERS_BY = {
    "latest": f"file_modified_at DESC, {WALK}",
    "oldest": f"file_created_at, {WALK}",
    "largest": f"size DESC, {WALK}",
}


def keep(source: str, order: str) -> str:
    """CTE `k`: rows with rank, size of group and kept path."""
    w = f"(PARTITION BY scan_id, hash ORDER BY {order})"
    return f"""k AS (SELECT *, row_number() OVER {w} AS rank, first_value(file_path) OVER {w} AS kept_path,
        first_value(size) OVER {w} AS kept_size, count(*) OVER (PARTITION BY scan_id, hash) AS copies FROM {source})"""


FLAGGED = f"""{M_VIEW}, {keep('m', ORDERS_BY['oldest'])},
r AS (SELECT scan_id, file_name, file_path, original_path, hash, extension, category, size, rank > 1 AS is_duplicate,
    CASE WHEN rank > 1 THEN kept_path END AS duplicate_of FROM k)"""

SCANS = f"""{FLAGGED},
s AS (SELECT scan_id, '/data/' || scan_id AS scanned_path, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size,
    count(*) FILTER (is_duplicate) AS duplicates_count,
    CAST(coalesce(sum(size) FILTER (is_duplicate), 0) AS BIGINT) AS duplicates_size,
    TIMESTAMP '2024-02-01' + to_days(CAST(list_position(['de','es','fr','en'], scan_id) - 1 AS INTEGER)) AS created_at
  FROM r GROUP BY scan_id)"""

TX = """t AS (SELECT o_orderkey AS tx_key, concat('tx-', CAST(o_orderkey AS STRING)) AS transaction_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'organize' WHEN 1 THEN 'dedupe' ELSE 'rollback' END AS type,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'partially_completed'
       WHEN o_orderkey % 2 = 0 THEN 'rolled_back' ELSE 'pending' END AS status,
  (o_orderstatus = 'P' AND o_orderkey % 2 <> 0) AS dry_run, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""

ACTIONS = TX + """,
a0 AS (SELECT t.tx_key, t.transaction_id, t.type AS tx_type, t.status AS tx_status, t.dry_run,
  CASE t.type WHEN 'organize' THEN 'move' WHEN 'dedupe' THEN 'delete' ELSE 'restore' END AS type,
  CASE WHEN t.dry_run THEN 'pending' WHEN l_returnflag = 'N' AND t.status = 'partially_completed' THEN 'failed'
       ELSE 'completed' END AS status,
  CAST(l_quantity * 1000 AS BIGINT) AS file_size, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
  FROM t JOIN lineitem ON l_orderkey = t.tx_key),
a AS (SELECT *, CASE WHEN status = 'failed' THEN 'File is locked/busy' END AS error,
  concat('/data/p', l_partkey, '/o', tx_key, '_', seq, '.txt') AS from_path,
  CASE WHEN type = 'delete' AND seq % 5 = 0 THEN '' ELSE concat('/moved/s', l_suppkey, '/o', tx_key, '_', seq, '.txt') END
    AS to_path FROM a0),
present AS (SELECT to_path AS path FROM a WHERE to_path <> '' AND seq % 4 <> 0
            UNION SELECT from_path FROM a WHERE seq % 6 = 0)"""

COUNTERS = ACTIONS + """,
c AS (SELECT transaction_id,
    count(*) FILTER (status = 'completed' AND type = 'move') AS moved_count,
    count(*) FILTER (status = 'completed' AND type = 'delete') AS deleted_count,
    count(*) FILTER (status = 'completed' AND type = 'restore') AS restored_count,
    count(*) FILTER (status = 'failed') AS failed_count, count(*) AS total_processed,
    coalesce(sum(file_size) FILTER (type = 'delete'), 0) AS planned,
    coalesce(sum(file_size) FILTER (type = 'delete' AND status = 'completed'), 0) AS exact FROM a GROUP BY 1),
ts AS (SELECT t.*, coalesce(moved_count, 0) AS moved_count, coalesce(deleted_count, 0) AS deleted_count,
    coalesce(restored_count, 0) AS restored_count, coalesce(failed_count, 0) AS failed_count,
    coalesce(total_processed, 0) AS total_processed, CAST(coalesce(exact, 0) AS BIGINT) AS saved_bytes_exact,
    CAST(coalesce(floor(CAST(planned AS DOUBLE) * (CAST(deleted_count AS DOUBLE) / greatest(total_processed, 1)) + 0.5), 0) AS BIGINT) AS saved_bytes
  FROM t LEFT JOIN c USING (transaction_id))"""

ABLE = "status IN ('completed', 'partially_completed') AND NOT dry_run"

EVENTS = TX + f""",
ev AS (SELECT transaction_id, 0 AS event_seq, status, CAST(NULL AS TIMESTAMP) AS rolled_back_at,
    CAST(NULL AS VARCHAR) AS rollback_transaction_id FROM t WHERE type = 'dedupe' AND {ABLE}
  UNION ALL SELECT concat('tx-', tx_key - 1), 1, 'rolled_back', created_at, transaction_id
  FROM t WHERE type = 'rollback' AND {ABLE}),
last AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY event_seq DESC) = 1),
st AS (SELECT t.transaction_id, t.type, coalesce(last.status, t.status) AS status, last.rolled_back_at,
    last.rollback_transaction_id FROM t LEFT JOIN last USING (transaction_id))"""

JUDGED = ACTIONS + f""",
open AS (SELECT a.* FROM a JOIN t USING (transaction_id) WHERE a.status = 'completed'
    AND t.status IN ('completed', 'partially_completed') AND NOT t.dry_run),
j0 AS (SELECT *, to_path <> '' AND to_path IN (SELECT path FROM present) AS there,
    from_path IN (SELECT path FROM present) AS taken FROM open),
j AS (SELECT *, CASE
    WHEN type = 'move' AND NOT there THEN 'File no longer exists at moved location'
    WHEN type = 'move' AND taken THEN 'Original location is no longer available (file exists)'
    WHEN type = 'delete' AND NOT there THEN 'File was permanently deleted or trash file not found'
    WHEN type = 'restore' THEN 'Unknown action type: restore' ELSE '' END AS why,
  CASE WHEN why = '' THEN 'restored' ELSE 'skipped' END AS outcome FROM j0)"""

TREE = """concat('/', lang, CASE doc_id % 11 WHEN 3 THEN '/.cache' WHEN 5 THEN '/node_modules' ELSE '' END,
    '/s', doc_id % 20, '/', CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END, 'doc ', doc_id, '.txt')"""

PAGE = "concat('/', regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''))"


def with_(views: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{views} {select}"


# ---- sources and sinks ----

VISIBLE = "doc_id % 11 NOT IN (3, 5)"
ORACLE["list_tree"] = f"SELECT {TREE} AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE {VISIBLE}"
ORACLE["list_flat"] = f"SELECT {TREE} AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents"
ORACLE["listing_rules"] = f"SELECT concat('/top', {TREE}) AS file_path FROM documents WHERE {VISIBLE}"
ORACLE["scan_errors"] = f"SELECT DISTINCT {PAGE} AS path, 'ENOENT' AS error FROM pages"
ORACLE["normalize_path"] = with_(F_VIEW, f"""SELECT file_path, file_path AS clean FROM f
    UNION ALL SELECT {PAGE}, '/data/default' FROM pages""")
ORACLE["save_and_reload"] = with_(FLAGGED, """SELECT scan_id, file_name, file_path, original_path, hash, extension,
    category, size, is_duplicate, duplicate_of FROM r""")
ORACLE["ledger_current_state"] = with_(EVENTS, "SELECT * FROM st")

# ---- projections, filters, lookups ----

RECORD = "scan_id, file_path, hash, extension, category, size, is_duplicate, duplicate_of"
ORACLE["manifest"] = with_(M_VIEW, "SELECT * FROM m")
ORACLE["records_by_scan"] = with_(FLAGGED, f"SELECT {RECORD} FROM r WHERE scan_id = 'fr'")
ORACLE["duplicates_by_scan"] = with_(FLAGGED, f"SELECT {RECORD} FROM r WHERE scan_id = 'en' AND is_duplicate")
ORACLE["scan_by_id"] = with_(SCANS, "SELECT * FROM s WHERE scan_id = 'es'")
HEAD = "transaction_id, type, status, dry_run, created_at"
NEWEST = "ORDER BY created_at DESC, transaction_id"
ORACLE["transaction_by_id"] = with_(TX, f"SELECT {HEAD} FROM t WHERE transaction_id = 'tx-7'")
ORACLE["rollbackable"] = with_(TX, f"SELECT {HEAD} FROM t WHERE {ABLE}")
ORACLE["rollbackable_dashboard"] = with_(TX, f"""SELECT {HEAD}, {ABLE} AND type <> 'rollback' AS can_roll_back
    FROM t {NEWEST} LIMIT 15""")
ORACLE["rollback_history"] = with_(TX, f"SELECT {HEAD} FROM t WHERE type = 'rollback'")
ORACLE["recent_by_type"] = with_(TX, f"SELECT {HEAD} FROM t WHERE type = 'dedupe' {NEWEST} LIMIT 10")
ORACLE["recent_transactions_50"] = with_(TX, f"SELECT {HEAD} FROM t {NEWEST} LIMIT 50")
ORACLE["organizable"] = with_(F_VIEW, "SELECT scan_id, file_path FROM f")
ORACLE["organizable_direct"] = with_(F_VIEW, """SELECT scan_id, file_path FROM f
    WHERE regexp_matches(file_path, '^/data/[a-z]+/s1/b0/[^/]+$')""")
ORACLE["completed_actions"] = with_(ACTIONS, """SELECT transaction_id, seq, type, from_path, to_path, file_size FROM a
    WHERE status = 'completed'""")
ORACLE["validate_ledger"] = with_(f"{M_VIEW}, {ACTIONS}", """SELECT source, reasons = '' AS valid, reasons, count(*) AS n FROM (
    SELECT 'actions' AS source, CASE WHEN seq % 5 = 0 AND seq % 7 = 0 THEN 'from_path missing;status not allowed'
        WHEN seq % 5 = 0 THEN 'from_path missing' WHEN seq % 7 = 0 THEN 'status not allowed' ELSE '' END AS reasons FROM a
    UNION ALL SELECT 'transactions', CASE WHEN dry_run THEN 'type not allowed' ELSE '' END FROM t
    UNION ALL SELECT 'files', CASE WHEN extension = '' THEN 'hash missing' ELSE '' END FROM m)
    GROUP BY ALL""")

# ---- scan ----

ORACLE["categorize"] = with_(f"""{EXT}, {F_VIEW}, p AS (SELECT file_path FROM f UNION ALL SELECT {PAGE} FROM pages),
    q AS (SELECT file_path, lower({ext_of(name_of('file_path'))}) AS extension FROM p)""",
    "SELECT file_path, q.extension, coalesce(category, 'Others') AS category FROM q LEFT JOIN ext ON q.extension = ext.extension")
ORACLE["scan_flag_duplicates"] = with_(FLAGGED, "SELECT scan_id, file_path, hash, is_duplicate, duplicate_of FROM r")
ORACLE["scan_summary"] = with_(SCANS, "SELECT scan_id, total_files, total_size, duplicates_count, duplicates_size FROM s")
ORACLE["scan_categories"] = with_(M_VIEW, """SELECT scan_id, category, count(*) AS count, CAST(sum(size) AS BIGINT) AS size,
    CAST(floor(CAST(sum(size) AS DOUBLE) / CAST(sum(sum(size)) OVER (PARTITION BY scan_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS pct
    FROM m GROUP BY scan_id, category""")
GROUPS = f"""{F_VIEW}, {keep('f', ORDERS_BY['oldest'])},
g AS (SELECT scan_id, hash, count(*) AS copies, CAST(sum(size) AS BIGINT) AS total_size,
    CAST(sum(size) - any_value(kept_size) AS BIGINT) AS wasted_size, any_value(kept_path) AS original
  FROM k WHERE copies > 1 GROUP BY scan_id, hash)"""
ORACLE["duplicate_groups"] = with_(GROUPS, "SELECT * FROM g")
ORACLE["top_duplicate_groups"] = with_(GROUPS, """SELECT *, (SELECT greatest(count(*) - 10, 0) FROM g) AS more FROM g
    ORDER BY wasted_size DESC, scan_id, hash LIMIT 10""")
ORACLE["directory_size"] = with_(F_VIEW, f"""SELECT scan_id, CASE WHEN folder = '' THEN '/' ELSE folder END AS folder,
    count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM (
      SELECT scan_id, size, unnest(list_transform(range(1, len({WALK})), lambda i: array_to_string(({WALK})[1:i], '/'))) AS folder
      FROM f) GROUP BY ALL""")
ORACLE["recent_scans"] = with_(SCANS, "SELECT * FROM s ORDER BY created_at DESC, scan_id LIMIT 10")
ORACLE["recent_scans_20"] = with_(SCANS, "SELECT * FROM s ORDER BY created_at DESC, scan_id LIMIT 20")
ORACLE["latest_scan"] = with_(SCANS, "SELECT * FROM s ORDER BY created_at DESC, scan_id LIMIT 1")

# ---- dedupe ----

for strategy, by in ORDERS_BY.items():
    ORACLE[f"dedupe_{strategy}"] = with_(f"{F_VIEW}, {keep('f', by)}",
                                         "SELECT scan_id, hash, file_path, size, kept_path FROM k WHERE rank > 1")
ORACLE["dedupe_ranked"] = with_(f"{F_VIEW}, {keep('f', ORDERS_BY['latest'])}",
                                "SELECT scan_id, hash, file_path, rank, rank = 1 AS is_kept FROM k WHERE copies > 1")
DOOMED = f"{F_VIEW}, {keep('f', ORDERS_BY['latest'])}, d AS (SELECT * FROM k WHERE rank > 1)"
SHORT_ID = "substr(sha256(concat({tx}, chr(0), {path})), 1, 8)"


def deletions(prefix: str, to: str) -> str:
    tx = f"'{prefix}-' || scan_id"
    return f"""SELECT {tx} AS transaction_id, {SHORT_ID.format(tx=tx, path='file_path')} AS action_id, 'delete' AS type,
        file_path AS from_path, {to} AS to_path, 'pending' AS status, hash AS file_hash, size AS file_size FROM d"""


ORACLE["dedupe_actions"] = with_(DOOMED, deletions("dedupe", f"concat('{TRASH}/', {name_of('file_path')})")
                                 + " UNION ALL " + deletions("purge", "''"))
LOCKED = "file_path LIKE '%.exe'"
ORACLE["dedupe_summary"] = with_(f"""{DOOMED}, x AS (SELECT scan_id, count(DISTINCT hash) AS groups, count(*) AS n,
    sum(size) AS planned, count(*) FILTER (NOT {LOCKED}) AS deleted, count(*) FILTER ({LOCKED}) AS failed,
    coalesce(sum(size) FILTER (NOT {LOCKED}), 0) AS exact FROM d GROUP BY scan_id)""",
    """SELECT scan_id, groups, n AS duplicate_files, deleted AS deleted_count, failed AS failed_count,
    CAST(floor(CAST(planned AS DOUBLE) * (CAST(deleted AS DOUBLE) / n) + 0.5) AS BIGINT) AS saved_bytes,
    CAST(exact AS BIGINT) AS saved_bytes_exact FROM x""")
ORACLE["dedupe_apply"] = with_(f"{F_VIEW}, {keep('f', ORDERS_BY['latest'])}",
                               f"SELECT scan_id, file_path, hash, size FROM k WHERE rank = 1 OR {LOCKED}")
ORACLE["saved_bytes"] = with_(COUNTERS, "SELECT transaction_id, saved_bytes, saved_bytes_exact FROM ts WHERE type = 'dedupe'")
ORACLE["dedupe_progressive"] = with_(
    f"""f AS (SELECT lang AS scan_id, {TREE} AS file_path, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size,
    {TIMES} FROM documents), {keep('f', ORDERS_BY['latest'])}""",
    "SELECT scan_id, hash, file_path, size, kept_path FROM k WHERE rank > 1")

# ---- names: one file after another, by recursion over the rank in each family of names ----

FAMILY = r"regexp_replace({stem}, '(_\d+)+$', '')"


def sequence(planned: str, existing: str) -> str:
    """CTEs giving `done(id, final_path)`; planned has id, dir, name, ord; existing has path."""
    def parsed(source: str, columns: str) -> str:
        stem = f"left(name, length(name) - length({ext_of('name')}))"
        return f"""SELECT {columns}, dir, name, {ext_of('name')} AS tail, {stem} AS stem,
            {FAMILY.format(stem=stem)} AS family FROM {source}"""

    return f"""pl0 AS ({planned}), pl1 AS ({parsed('pl0', 'id, ord')}),
    pl AS (SELECT *, row_number() OVER (PARTITION BY dir, family, tail ORDER BY ord) AS turn FROM pl1),
    ex0 AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, {name_of('path')} AS name FROM ({existing})),
    ex1 AS ({parsed('ex0', '1 AS one')}),
    ex AS (SELECT dir, family, tail, list(name) AS names FROM ex1 GROUP BY ALL),
    run AS (
      SELECT DISTINCT pl.dir, pl.family, pl.tail, CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS id,
        CAST(NULL AS VARCHAR) AS pick, coalesce(ex.names, CAST([] AS VARCHAR[])) AS taken
      FROM pl LEFT JOIN ex ON pl.dir = ex.dir AND pl.family = ex.family AND pl.tail = ex.tail
      UNION ALL
      SELECT dir, family, tail, turn, id, pick, list_append(taken, pick) FROM (
        SELECT run.dir, run.family, run.tail, pl.turn, pl.id, run.taken,
          CASE WHEN NOT list_contains(run.taken, pl.name) THEN pl.name ELSE
            list_filter(list_transform(range(1, least(len(run.taken) + 2, 1000)), lambda i: concat(pl.stem, '_', i, pl.tail)),
                        lambda c: NOT list_contains(run.taken, c))[1] END AS pick
        FROM run JOIN pl ON pl.dir = run.dir AND pl.family = run.family AND pl.tail = run.tail AND pl.turn = run.turn + 1)),
    done AS (SELECT id, dir || '/' || pick AS final_path FROM run WHERE turn > 0)"""


TRASHED = sequence(
    f"SELECT file_path AS id, {WALK} AS ord, '{TRASH}' AS dir, concat('{RUN_MILLIS}_', {name_of('file_path')}) AS name FROM d",
    f"SELECT concat('{TRASH}/{RUN_MILLIS}_', {name_of('file_path')}) AS path FROM f WHERE scan_id = 'de'",
)
ORACLE["trash_names"] = with_(f"{DOOMED}, {TRASHED}", "SELECT id AS from_path, final_path FROM done", recursive=True)

# ---- organize ----

PLAN = f"""{M_VIEW},
p AS (SELECT scan_id, file_path AS from_path, concat('/data/', scan_id, '/', category, '/', file_name) AS to_path, category,
    file_name, size FROM m)"""
SETTLED = "SELECT concat('/data/', scan_id, '/', category, '/', file_name) AS path FROM m WHERE file_path LIKE '/data/%/s1/b0/%'"
PLACED = f"{PLAN}, " + sequence(
    "SELECT file_path AS id, string_split(file_path, '/') AS ord, concat('/data/', scan_id, '/', category) AS dir, file_name AS name FROM m",
    SETTLED,
)
ORACLE["organize_plan"] = with_(PLAN, "SELECT * FROM p")
ORACLE["organize_by_category"] = with_(PLAN, "SELECT scan_id, category, count(*) AS files FROM p GROUP BY ALL")
ORACLE["plan_preview"] = with_(PLAN, """SELECT scan_id, from_path, to_path, (SELECT greatest(count(*) - 20, 0) FROM p) AS more
    FROM p ORDER BY string_split(from_path, '/'), scan_id LIMIT 20""")
ORACLE["organize_collision_exact"] = with_(PLACED, """SELECT id AS from_path, final_path,
    CASE WHEN final_path IS NULL THEN 'collision limit' END AS error FROM done""", recursive=True)
ORACLE["organize_apply"] = with_(PLACED, f"""SELECT scan_id, coalesce(final_path, file_path) AS file_path,
    {name_of('coalesce(final_path, file_path)')} AS file_name, original_path, category
    FROM m LEFT JOIN done ON done.id = m.file_path""", recursive=True)
ORACLE["organize_summary"] = with_(PLACED, """SELECT scan_id, CAST(sum(n) AS BIGINT) AS total_files, CAST(sum(ok) AS BIGINT) AS moved_count,
    CAST(sum(n - ok) AS BIGINT) AS failed_count, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category FROM (
      SELECT scan_id, category, count(*) AS n, count(final_path) AS ok FROM m JOIN done ON done.id = m.file_path
      GROUP BY scan_id, category) GROUP BY scan_id""", recursive=True)

CHILD = "'^(.+)_([1-9][0-9]{0,2})$'"
ORACLE["organize_collision_fast"] = with_(f"""{PLAN}, e AS ({SETTLED}),
w AS (SELECT to_path AS path, count(*) AS wanted, FALSE AS there FROM p GROUP BY 1
      UNION ALL SELECT DISTINCT path, 0, TRUE FROM e),
u AS (SELECT path, CAST(sum(wanted) AS BIGINT) AS wanted, bool_or(there) AS there,
    {ext_of(name_of('path'))} AS tail, left(path, length(path) - length(tail)) AS body FROM w GROUP BY path),
v AS (SELECT *, regexp_extract({name_of('body')}, {CHILD}, 1) AS short,
    CASE WHEN short = '' THEN '' ELSE regexp_extract(body, '^(.+/)[^/]*$', 1) || short || tail END AS parent FROM u),
link AS (SELECT c.path AS child, c.parent FROM v c JOIN v q ON q.path = c.parent
         WHERE c.parent <> '' AND q.wanted > 0 AND (q.wanted > 1 OR q.there OR q.parent <> '')),
linked AS (SELECT child AS path FROM link UNION SELECT parent FROM link),
z AS (SELECT from_path, to_path, row_number() OVER (PARTITION BY to_path ORDER BY string_split(from_path, '/')) AS rank FROM p)""",
    """SELECT from_path, rank, linked.path IS NOT NULL AS linked,
    CASE WHEN linked.path IS NULL AND rank - 1 + CAST(v.there AS INT) <= 999 THEN
      CASE WHEN rank - 1 + CAST(v.there AS INT) = 0 THEN to_path
           ELSE concat(body, '_', rank - 1 + CAST(v.there AS INT), tail) END END AS final_path
    FROM z JOIN v ON v.path = z.to_path LEFT JOIN linked ON linked.path = z.to_path""")

# ---- ledger ----

ORACLE["ledger_nested"] = with_(ACTIONS, """SELECT t.transaction_id, t.type, coalesce((min(seq) - 1) // 10000, 0) AS page, count(seq) AS n,
    coalesce(string_agg(concat_ws(':', seq, a.type, a.status, from_path), ',' ORDER BY seq), '') AS actions
    FROM t LEFT JOIN a USING (transaction_id) GROUP BY t.transaction_id, t.type, (seq - 1) // 10000""")
SIX = "moved_count, deleted_count, restored_count, failed_count, saved_bytes, total_processed, saved_bytes_exact"
ORACLE["ledger_summary"] = with_(COUNTERS, f"SELECT transaction_id, type, {SIX} FROM ts")
ORACLE["ledger_status"] = with_(COUNTERS, """SELECT transaction_id, CASE WHEN dry_run THEN 'pending'
    WHEN failed_count = 0 THEN 'completed' ELSE 'partially_completed' END AS status FROM ts""")
ORACLE["record_outcomes"] = with_(ACTIONS, """SELECT transaction_id, seq,
    CASE WHEN to_path = '' THEN 'pending' WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN to_path <> '' THEN coalesce(error, '') ELSE '' END AS error,
    CASE WHEN to_path <> '' AND status <> 'failed' AND seq % 3 = 0 THEN to_path || '.1' ELSE to_path END AS to_path FROM a""")
ORACLE["error_reason"] = """SELECT code, message, n,
    CASE code WHEN 'EACCES' THEN 'Permission denied' WHEN 'EBUSY' THEN 'File is locked/busy' WHEN 'ENOENT' THEN 'File not found'
      ELSE plain END AS on_move,
    CASE code WHEN 'EACCES' THEN 'Permission denied' WHEN 'EBUSY' THEN 'File is locked/busy' ELSE plain END AS on_delete
  FROM (SELECT code, message, count(*) AS n, CASE WHEN message = '' THEN 'Unknown error' ELSE message END AS plain FROM (
    SELECT CASE l_returnflag WHEN 'A' THEN 'EACCES' WHEN 'R' THEN 'EBUSY' ELSE
        CASE l_linestatus WHEN 'O' THEN 'ENOENT' ELSE 'EIO' END END AS code,
      CASE WHEN l_linenumber = 1 THEN '' ELSE concat('error ', l_linenumber) END AS message FROM lineitem) GROUP BY code, message)"""
ORACLE["rollback_pairs"] = with_(EVENTS, """SELECT x.transaction_id, x.type, x.rolled_back_at, x.rollback_transaction_id,
    y.status AS rollback_status FROM st x JOIN st y ON y.transaction_id = x.rollback_transaction_id WHERE y.type = 'rollback'""")
ORACLE["present_paths"] = with_(ACTIONS, "SELECT path FROM present")

# ---- rollback ----

ORACLE["rollback_eligibility"] = with_(TX, """SELECT q.id AS transaction_id, CASE
    WHEN t.status IS NULL THEN 'Transaction not found: ' || q.id
    WHEN t.status = 'rolled_back' THEN 'Transaction has already been rolled back: ' || q.id
    WHEN t.dry_run THEN 'Cannot rollback a dry-run transaction: ' || q.id ELSE '' END AS reason
    FROM (SELECT concat('tx-', c_custkey) AS id FROM customer UNION ALL SELECT concat('cx-', c_custkey) FROM customer) q
    LEFT JOIN t ON t.transaction_id = q.id""")
ORACLE["rollback_plan"] = with_(JUDGED, "SELECT transaction_id, seq, type, from_path FROM open")
ORACLE["rollback_outcomes"] = with_(JUDGED, "SELECT transaction_id, seq, type, outcome, why AS error FROM j")
ORACLE["rollback_restored_paths"] = with_(f"{JUDGED}, " + sequence(
    """SELECT concat(transaction_id, '|', seq) AS id, [transaction_id, lpad(CAST(1000000 - seq AS VARCHAR), 9, '0')] AS ord,
       regexp_extract(from_path, '^(.*)/[^/]*$', 1) AS dir, """ + name_of("from_path") + """ AS name
       FROM j WHERE outcome = 'restored' AND type = 'delete'""",
    "SELECT path FROM present UNION ALL SELECT from_path FROM j WHERE outcome = 'restored' AND type = 'move'",
), """SELECT split_part(id, '|', 1) AS transaction_id, CAST(split_part(id, '|', 2) AS BIGINT) AS seq, final_path FROM done
    UNION ALL SELECT transaction_id, seq, from_path FROM j WHERE outcome = 'restored' AND type = 'move'""", recursive=True)
ORACLE["rollback_actions"] = with_(JUDGED, """SELECT 'undo-' || transaction_id AS transaction_id, seq, 'restore' AS type,
    CASE WHEN to_path = '' THEN from_path ELSE to_path END AS from_path, from_path AS to_path, 'completed' AS status, outcome,
    file_size, why AS error FROM j""")
ORACLE["rollback_summary"] = with_(JUDGED, """SELECT transaction_id, count(*) AS total_actions,
    count(*) FILTER (outcome = 'restored') AS restored_count, count(*) FILTER (outcome = 'failed') AS failed_count,
    count(*) FILTER (outcome = 'skipped') AS skipped_count, 'completed' AS status FROM j GROUP BY 1""")
ORACLE["rollback_nonrestored"] = with_(JUDGED, """SELECT transaction_id, seq, outcome, why AS error,
    (SELECT greatest(count(*) - 10, 0) FROM j WHERE outcome <> 'restored') AS more FROM j WHERE outcome <> 'restored'
    ORDER BY transaction_id, seq DESC LIMIT 10""")

# ---- report ----

SHELF = "['a.txt', 'a_1.txt', 'b', 'b_2', 'c.x', 'd']"
SERIES = f"left(from_path, length(from_path) - length({ext_of(name_of('from_path'))})) || '_' || i || {ext_of(name_of('from_path'))}"
ORACLE["rollback_batch"] = with_(JUDGED + f""",
sh0 AS (SELECT transaction_id, seq, type, t.created_at, tx_key, l_partkey AS part, concat('/data/p', l_partkey, '/') AS dir,
    concat(dir, {SHELF}[(tx_key + seq) % 6 + 1]) AS from_path, CASE WHEN open.to_path = '' THEN ''
      WHEN open.type = 'delete' THEN concat(dir, '.trash/', tx_key % 4) ELSE concat(dir, {SHELF}[(tx_key * 5 + seq * 7 + 1) % 6 + 1]) END AS to_path
    FROM (SELECT transaction_id, seq, type, tx_key, l_partkey, to_path FROM open) open JOIN (SELECT tx_key AS k, created_at FROM t) t ON t.k = open.tx_key),
sh AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY created_at DESC, tx_key, seq DESC) AS turn FROM sh0),
run AS (
  SELECT DISTINCT part, CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS transaction_id, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS from_path,
    CAST(NULL AS VARCHAR) AS to_path, '' AS why, CAST(NULL AS VARCHAR) AS pick, list_concat(
      list_transform(list_filter(range(6), lambda i: (part + i) % 3 = 0), lambda i: concat(dir, {SHELF}[i + 1])),
      list_transform(range(3), lambda i: concat(dir, '.trash/', i))) AS taken FROM sh
  UNION ALL
  SELECT part, turn, transaction_id, seq, from_path, to_path, why, pick,
    CASE WHEN pick IS NULL THEN taken ELSE list_append(list_filter(taken, lambda x: x <> to_path), pick) END FROM (
    SELECT *, CASE WHEN why <> '' THEN NULL WHEN NOT list_contains(taken, from_path) THEN from_path ELSE
        list_filter(list_transform(range(1, least(len(taken) + 2, 1000)), lambda i: {SERIES}), lambda c: NOT list_contains(taken, c))[1] END AS pick FROM (
      SELECT sh.part, sh.turn, sh.transaction_id, sh.seq, sh.from_path, sh.to_path, run.taken, CASE
        WHEN type = 'move' AND NOT list_contains(taken, sh.to_path) THEN 'File no longer exists at moved location'
        WHEN type = 'move' AND list_contains(taken, sh.from_path) THEN 'Original location is no longer available (file exists)'
        WHEN type = 'delete' AND NOT list_contains(taken, sh.to_path) THEN 'File was permanently deleted or trash file not found'
        WHEN type = 'restore' THEN 'Unknown action type: restore' ELSE '' END AS why
      FROM run JOIN sh ON sh.part = run.part AND sh.turn = run.turn + 1)))""", """SELECT transaction_id, seq, from_path, to_path,
    CASE WHEN why = '' THEN 'restored' ELSE 'skipped' END AS outcome, why AS error, coalesce(pick, '') AS final_path FROM run WHERE turn > 0""", recursive=True)

SAVED = """sv AS (SELECT coalesce(CAST(sum(saved_bytes) FILTER (status IN ('completed', 'partially_completed')) AS BIGINT), 0) AS kept,
    coalesce(CAST(sum(saved_bytes) FILTER (status = 'rolled_back') AS BIGINT), 0) AS undone
  FROM ts WHERE type = 'dedupe' AND NOT dry_run)"""
SAVED_COLUMNS = """(SELECT greatest(0, kept - undone) FROM sv) AS total_disk_space_saved, (SELECT kept FROM sv) AS space_saved_net,
    (SELECT count(*) FROM t) AS total_transactions"""
ORACLE["report_space_saved"] = with_(f"{COUNTERS}, {SAVED}", f"SELECT {SAVED_COLUMNS}")
ORACLE["report_overview"] = with_(f"{SCANS}, {COUNTERS}, {SAVED}", f"""SELECT (SELECT count(*) FROM s) AS total_scans,
    (SELECT count(*) FROM r) AS total_files_scanned, (SELECT count(*) FROM r WHERE is_duplicate) AS total_duplicates_found,
    {SAVED_COLUMNS}""")
LATEST = "(SELECT scan_id FROM s ORDER BY created_at DESC, scan_id LIMIT 1)"
ORACLE["report_category_breakdown"] = with_(SCANS, f"""SELECT category, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size,
    CAST(floor(CAST(sum(size) AS DOUBLE) / CAST(sum(sum(size)) OVER () AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage
    FROM r WHERE scan_id = {LATEST} GROUP BY category""")
ORACLE["report_extension_stats"] = with_(FLAGGED, """SELECT CASE WHEN e = '' THEN 'No extension' ELSE e END AS extension, count, total_size
    FROM (SELECT extension AS e, count(*) AS count, CAST(sum(size) AS BIGINT) AS total_size FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""")
ORACLE["report_duplicate_stats"] = with_(SCANS, f"""SELECT (SELECT count(DISTINCT hash) FROM r WHERE is_duplicate AND scan_id = {LATEST}) AS total_groups,
    duplicates_count AS total_duplicate_files, duplicates_size AS total_wasted_space FROM s WHERE scan_id = {LATEST}""")
ORACLE["report_top_dup_ext"] = with_(SCANS, f"""SELECT CASE WHEN e = '' THEN 'No extension' ELSE e END AS extension, count FROM (
    SELECT extension AS e, count(*) AS count FROM r WHERE is_duplicate AND scan_id = {LATEST} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)""")
ORACLE["report_recent_scans"] = with_(SCANS, "SELECT * FROM s ORDER BY created_at DESC, scan_id LIMIT 5")
ORACLE["report_recent_activity"] = with_(COUNTERS, f"""SELECT transaction_id, type, status, moved_count, deleted_count, restored_count,
    saved_bytes, created_at FROM ts {NEWEST} LIMIT 10""")

ORACLE["catalogue_current"] = with_(f"""{FLAGGED}, c0 AS (SELECT *, size % 1155 AS n,
    CASE WHEN size % 1155 % 3 = 0 THEN file_path || '.m1' ELSE file_path END AS p1 FROM r),
  c1 AS (SELECT *, n % 5 = 0 AND NOT (n % 2 <> 0 AND n % 4 = 1) AS gone,
    CASE WHEN n % 7 = 0 AND n % 11 <> 0 THEN p1 || '.m4' ELSE p1 END AS now FROM c0)""",
    f"SELECT scan_id, now AS file_path, {name_of('now')} AS file_name, original_path FROM c1 WHERE NOT gone")
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"


def rows_of(key: str, columns: str, order: str) -> str:
    """A section of the report as an ordered list of structs."""
    fields = ", ".join(f"'{c}': {ISO.format(c) if c == 'created_at' else c}" for c in columns.split())
    return f"(SELECT list({{{fields}}} ORDER BY {order}) FROM ({BODIES[key]}))"


BODIES = {k: ORACLE[f"report_{k}"] for k in ("recent_scans", "category_breakdown", "extension_stats", "recent_activity", "top_dup_ext")}
ONE = {k: ORACLE[f"report_{k}"] for k in ("overview", "duplicate_stats")}
ORACLE["report_json"] = f"""SELECT CAST(to_json({{
    'overview': (SELECT o FROM ({ONE['overview']}) o),
    'recent_scans': {rows_of('recent_scans', 'scan_id scanned_path total_files total_size duplicates_count duplicates_size created_at', 'created_at DESC, scan_id')},
    'category_breakdown': {rows_of('category_breakdown', 'category file_count total_size percentage', 'total_size DESC, category')},
    'extension_stats': {rows_of('extension_stats', 'extension count total_size', 'count DESC, extension')},
    'recent_activity': {rows_of('recent_activity', 'transaction_id type status moved_count deleted_count restored_count saved_bytes created_at',
                                'created_at DESC, transaction_id')},
    'top_duplicated_extensions': {rows_of('top_dup_ext', 'extension count', 'count DESC, extension')},
    'duplicate_stats': (SELECT d FROM ({ONE['duplicate_stats']}) d)}}) AS VARCHAR) AS report"""
FILE_FIELDS = f"""'path': file_path, 'name': file_name, 'hash': hash, 'extension': extension, 'category': category, 'size': size,
    'createdAt': {ISO.format('file_created_at')}, 'modifiedAt': {ISO.format('file_modified_at')}, 'isDuplicate': is_duplicate, 'duplicateOf': duplicate_of"""
ORACLE["scan_documents"] = with_(f"""{SCANS}, rn AS (SELECT r.*, f.file_created_at, f.file_modified_at, row_number() OVER (PARTITION BY scan_id ORDER BY {WALK}) AS n
      FROM r JOIN f USING (scan_id, file_path)),
    pg AS (SELECT scan_id, (n - 1) // 50 AS page, list({{{FILE_FIELDS}}} ORDER BY n) AS files FROM rn GROUP BY ALL),
    cg AS (SELECT scan_id, map(list(category ORDER BY category), list({{'count': c, 'size': z}} ORDER BY category)) AS categories
      FROM (SELECT scan_id, category, count(*) AS c, CAST(sum(size) AS BIGINT) AS z FROM r GROUP BY ALL) GROUP BY scan_id)""",
    """SELECT scan_id, page, CAST(to_json({'scanId': scan_id, 'scannedPath': scanned_path, 'totalFiles': total_files, 'totalSize': total_size,
    'duplicatesCount': duplicates_count, 'duplicatesSize': duplicates_size, 'categories': categories, 'page': page, 'files': files}) AS VARCHAR) AS document
    FROM s JOIN pg USING (scan_id) JOIN cg USING (scan_id)""")
SUMMARY_JSON = ", ".join(f"'{n}': {c}" for c, n in (
    ("moved_count", "movedCount"), ("deleted_count", "deletedCount"), ("restored_count", "restoredCount"), ("failed_count", "failedCount"),
    ("saved_bytes", "savedBytes"), ("total_processed", "totalProcessed")))
ORACLE["run_documents"] = with_(f"""{COUNTERS}, pg AS (SELECT transaction_id, (seq - 1) // 4 AS page,
      list({{'from': from_path, 'to': to_path, 'status': status, 'error': error, 'size': file_size}} ORDER BY seq) AS actions FROM a GROUP BY ALL)""",
    f"""SELECT transaction_id, coalesce(page, 0) AS page, CAST(to_json({{'transactionId': transaction_id, 'type': type, 'status': status,
    'targetPath': concat('/data/p', o_custkey), 'dryRun': dry_run, 'strategy': CASE WHEN type = 'dedupe' THEN 'keep-latest' END,
    'summary': {{{SUMMARY_JSON}}}, 'page': coalesce(page, 0), 'actions': coalesce(actions, [])}}) AS VARCHAR) AS document
    FROM ts JOIN orders ON o_orderkey = tx_key LEFT JOIN pg USING (transaction_id)""")

# ---- scalar functions ----

ORACLE["file_extension"] = f"""SELECT path, lower({ext_of(name_of('path'))}) AS extension FROM (SELECT DISTINCT unnest([p_name, '.' || p_name,
    p_name || '.', p_name || '.TAR.gz', '..' || p_brand, '/my.dir/' || p_brand, '/d/' || p_brand || ' x.Md']) AS path FROM part)"""
POSITIONS = ", ".join(f"({i}, '{c}', {len(EXTENSIONS.get(c, '').split())})" for i, c in enumerate(CATEGORIES))
ORACLE["category_dim"] = with_(f"{M_VIEW}, cd(position, category, extensions) AS (VALUES {POSITIONS})", """SELECT position,
    cd.category, extensions, count(m.file_path) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS size
    FROM cd LEFT JOIN m ON m.category = cd.category GROUP BY ALL""")
ORACLE["extensions_for_category"] = with_(M_VIEW, """SELECT ext.category, ext.extension, count(m.file_path) AS files FROM ext
    LEFT JOIN m ON m.extension = ext.extension GROUP BY ALL""")
UNIT = "CASE " + " ".join(
    f"WHEN bytes < {1024 ** (i + 1)} THEN {i}" for i in range(5)
) + " ELSE 5 END"
ORACLE["format_bytes"] = f"""WITH b AS (SELECT DISTINCT unnest([0, n, n * 1000, n * 131072, n * 1000000000, n * 1000000000000]) AS bytes
    FROM (SELECT CAST(strlen(text) AS BIGINT) AS n FROM documents)),
  i AS (SELECT bytes, {UNIT} AS unit FROM b),
  h AS (SELECT bytes, unit, CAST((CAST(bytes AS HUGEINT) * 200 + CAST(pow(1024, unit) AS HUGEINT)) // (2 * CAST(pow(1024, unit) AS HUGEINT)) AS BIGINT) AS cents FROM i)
  SELECT bytes, CASE WHEN bytes = 0 THEN '0 Bytes' ELSE concat(
    regexp_replace(concat(cents // 100, '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0')), '\\.?0+$', ''), ' ',
    (['Bytes', 'KB', 'MB', 'GB', 'TB', 'PB'])[unit + 1]) END AS text FROM h"""
ORACLE["full_hash"] = "SELECT doc_id, sha256(text) AS of_column, sha256(text) AS of_file FROM documents"
ORACLE["partial_hash"] = """WITH x AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM documents),
  y AS (SELECT doc_id, h, size, least(65536, size // 2) AS c FROM x),
  z AS (SELECT doc_id, CASE WHEN size = 0 THEN sha256('empty') ELSE sha256(unhex(concat(left(h, 2 * c),
      CASE WHEN size > 2 * c THEN right(h, 2 * c) ELSE '' END, hex(encode(CAST(size AS VARCHAR)))))) END AS p FROM y)
  SELECT doc_id, p AS of_column, p AS of_file FROM z"""
ORACLE["path_parts"] = with_(f"{F_VIEW}, p AS (SELECT file_path FROM f UNION ALL SELECT {PAGE} FROM pages)",
    f"""SELECT file_path, {name_of('file_path')} AS name, CASE WHEN len({WALK}) = 2 THEN '/' ELSE regexp_extract(file_path, '^(.*)/[^/]*$', 1) END AS folder,
    ({WALK})[-2] AS parent, left(name, length(name) - length({ext_of(name_of('file_path'))})) AS stem, '/root/' || name AS joined FROM p""")

# ---- streaming ----

ORACLE["stream_duplicates"] = f"""WITH o AS (SELECT lang AS scan_id, sha256(text) AS hash, {DOC_PATH} AS file_path,
    (doc_id * 7919) % 86400 AS arrived FROM documents),
  p AS (SELECT *, first_value(file_path) OVER (PARTITION BY scan_id, hash ORDER BY arrived, {WALK}) AS original FROM o)
  SELECT scan_id, hash, file_path, file_path <> original AS is_duplicate, CASE WHEN file_path <> original THEN original END AS duplicate_of
  FROM p"""
ACTIVITY = "ev AS (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS type, CAST(round(value * 100) AS BIGINT) AS size FROM events)"
ORACLE["activity_tumbling"] = with_(ACTIVITY, """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
    time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM ev GROUP BY ALL""")
ORACLE["activity_sliding"] = with_(f"""{ACTIVITY}, sl AS (SELECT type, size,
    date_trunc('hour', ts) - to_hours(unnest(range(0, 6))) AS window_start FROM ev)""",
    """SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size
    FROM sl GROUP BY ALL""")
ORACLE["activity_session"] = with_(f"""{ACTIVITY},
    b AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM b)""",
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS size
    FROM c GROUP BY user_id, no""")
