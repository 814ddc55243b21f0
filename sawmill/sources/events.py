"""The driver's events table as a server log. The message text is one SQL expression that Spark and other
engines evaluate alike, so that a query and its check start from the same entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawmill.operators.enrich import enrich

#: Over columns u (user), k, v (decimal(18,2)) and event_type.
MESSAGE = r"""case
 when event_type = 'view' then case k % 5
  when 0 then concat('duration: ', cast(v as string), ' ms  statement: SELECT * FROM page WHERE id = ', cast(k as string))
  when 1 then concat('statement: select title, body FROM page WHERE slug = ''p', cast(k as string), ''' and state IN (1, 2, ', cast(k as string), ') limit 5;')
  when 2 then concat('duration: ', cast(v as string), ' ms')
  when 3 then concat('duration: ', cast(v as string), ' ms  parse s', cast(k % 7 as string), ': SELECT count(*) FROM visits WHERE day > ', cast(k as string), ' GROUP BY day')
  else concat('duration: ', cast(v as string), ' ms  execute s', cast(k % 7 as string), ': WITH x AS (SELECT 1) SELECT name FROM users, x WHERE id = ', cast(u as string)) end
 when event_type = 'click' then case k % 4
  when 0 then concat('duration: ', cast(v as string), ' ms  statement: UPDATE cart SET qty = ', cast(k as string), ' WHERE owner = ', cast(u as string))
  when 1 then concat('duration: ', cast(v as string), ' ms  bind s', cast(k % 7 as string), ': UPDATE cart SET qty = $1 WHERE owner = $2')
  when 2 then concat('duration: ', cast(v as string), ' ms  statement: DELETE FROM cart WHERE item = ''x', cast(k as string), '''')
  else concat('duration: ', cast(v as string), ' ms  plan:', chr(10), 'Query Text: SELECT * FROM big WHERE a = ', cast(k as string), chr(10), 'Seq Scan on big  (cost=0.00..', cast(k as string), '.00 rows=1 width=4)') end
 when event_type = 'purchase' then case k % 8
  when 3 then concat('checkpoint complete: wrote ', cast(k * 10 as string), ' buffers (', cast(k as string), '.5%); 0 WAL file(s) added, 1 removed, ', cast(k % 3 as string), ' recycled; write=', cast(v as string), ' s, sync=0.01 s, total=', cast(v as string), ' s; sync files=2, longest=0.01 s, average=0.01 s; distance=', cast(k * 100 as string), ' kB, estimate=', cast(k * 200 as string), ' kB')
  when 4 then case when k % 3 = 0 then 'checkpoints are occurring too frequently (9 seconds apart)' when k % 3 = 1 then 'checkpoint starting: time' else 'checkpoint starting: immediate force wait' end
  when 5 then concat('automatic ', case when k % 2 = 0 then 'vacuum' else 'analyze' end, ' of table "shop.public.t', cast(k % 9 as string), '": index scans: 1 pages: ', cast(k as string), ' removed, 10 remain, ', cast(k % 4 as string), ' skipped due to pins, ', cast(k % 6 as string), ' skipped frozen tuples: ', cast(k * 3 as string), ' removed, 7 remain, ', cast(k * 2 as string), ' are dead but not yet removable buffer usage: ', cast(k as string), ' hits, 2 misses, 1 dirtied WAL usage: ', cast(k as string), ' records, 3 full page images, ', cast(k * 1000000 as string), ' bytes CPU: user: 0.05 s, system: 0.01 s, elapsed: ', cast(v as string), ' s')
  when 7 then concat('temporary file: path "base/pgsql_tmp/pgsql_tmp', cast(u as string), '.', cast(k as string), '", size ', cast(k * 4000000 as string))
  else concat('duration: ', cast(v as string), ' ms  statement: INSERT INTO sales (item, price) VALUES (''it', cast(k as string), ''', ', cast(v as string), ')') end
 when event_type = 'signup' then case k % 2
  when 0 then concat('connection authorized: user=u', cast(u % 20 as string), ' database=db', cast(u % 5 as string), ' application_name=app', cast(k % 3 as string), ' host=10.0.0.', cast(k % 8 as string))
  else concat('disconnection: session time: 0:', cast(k % 60 as string), ':', cast(v as string), ' user=u', cast(u % 20 as string), ' database=db', cast(u % 5 as string), ' host=10.0.0.', cast(k % 8 as string), ' port=5000') end
 else case k % 10
  when 0 then concat('duplicate key value violates unique constraint "users_email_key" DETAIL: Key (email)=(u', cast(k as string), '@x.org) already exists. SQLSTATE: 23505')
  when 1 then concat('deadlock detected DETAIL: Process ', cast(u as string), ' waits')
  when 2 then case when k % 20 = 2 then 'canceling statement due to statement timeout' else 'canceling statement due to user request' end
  when 3 then concat('process ', cast(u as string), ' still waiting for ShareLock on transaction ', cast(k as string), '; blocking processes: ', cast(u + 1 as string), ', ', cast(u + 2 as string))
  when 4 then 'could not serialize access due to concurrent update'
  when 5 then case when k % 30 = 25 then 'could not accept SSL connection: certificate expired' else concat('password authentication failed for user "u', cast(u % 20 as string), '"') end
  when 6 then 'out of memory'
  when 7 then concat('could not write to file "base/', cast(u as string), '": No space left on device')
  when 8 then concat('replication slot "r', cast(k % 4 as string), '" lag: ', cast(k as string), case when k % 3 = 0 then ' MB' when k % 3 = 1 then ' bytes' else ' s' end)
  when 9 then case when k % 20 = 19 then concat('pgbouncer ERROR no more connections allowed to pool ', cast(k % 40 as string)) else concat('pgbouncer client login attempt: db=db', cast(u % 5 as string), ' user=u', cast(u % 20 as string), ' query=SELECT ', cast(k as string), ' ms=', cast(k as string)) end end
end"""

LEVEL = "case when event_type <> 'error' then 'LOG' when k % 50 = 7 then 'PANIC' when k % 10 in (5, 6) then 'FATAL' when k % 10 in (3, 9) then 'LOG' when k % 10 = 8 then 'WARNING' else 'ERROR' end"


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entries, enriched; seq is the event id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id as u", "event_type", "cast(value as decimal(18,2)) as v", "cast(get_json_object(props, '$.k') as bigint) as k")
    return enrich(
        base.selectExpr(
            "event_id as seq", "event_id as line_number", "ts as timestamp", f"{LEVEL} as log_level", "cast(u as int) as pid", "concat('u', cast(u % 20 as string)) as user",
            "concat('db', cast(u % 5 as string)) as database", "concat('app', cast(k % 3 as string)) as application_name", "concat('10.0.0.', cast(k % 8 as string)) as remote_host",
            # The long text is made once for each row: an expression that counts rows is neither copied into filters nor merged.
            f"case when monotonically_increasing_id() >= 0 then {MESSAGE} end as message", "'events' as source_file",
        )
    )
