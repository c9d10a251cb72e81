"""The given ``events`` table seen as raw records and as stored log entries.

The texts run unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

ENTRIES_SQL = """
SELECT CAST(event_id AS BIGINT) AS id,
 CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END AS ts,
 CASE WHEN event_id % 107 = 0 THEN NULL
      WHEN event_id % 109 = 0 THEN 'Other'
      WHEN event_type = 'error' THEN 'Error'
      WHEN event_type = 'purchase' THEN 'Warning'
      WHEN event_type = 'view' THEN 'Information'
      WHEN event_type = 'signup' THEN 'AuditSuccess'
      ELSE 'AuditFailure' END AS level,
 CASE WHEN event_id % 103 = 0 THEN NULL
      ELSE concat(event_type, ' by User ', CAST(user_id AS STRING), ' ', props) END AS message,
 CASE WHEN event_id % 113 = 0 THEN NULL
      ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS INT) END AS event_code,
 CASE WHEN event_id % 97 = 0 THEN NULL
      WHEN event_id % 89 = 0 THEN ''
      ELSE concat('svc-', CAST(user_id % 25 AS STRING)) END AS source,
 ts + INTERVAL '5' MINUTE AS created_at,
 concat('Session_202401', lpad(CAST(day(ts) AS STRING), 2, '0'), '_000000_',
        CASE WHEN user_id % 3 = 0 THEN 'System'
             WHEN user_id % 3 = 1 THEN 'Application' ELSE 'Security' END) AS session_id
FROM events
"""

RAW_SQL = """
SELECT event_id AS record_id,
 CASE WHEN user_id % 3 = 0 THEN 'System'
      WHEN user_id % 3 = 1 THEN 'Application' ELSE 'Security' END AS logfile,
 ts AS time_generated,
 CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS INT) END AS event_type,
 CASE event_id % 17
   WHEN 0 THEN 'Fehler' WHEN 1 THEN 'Предупреждение' WHEN 2 THEN 'Informationen'
   WHEN 3 THEN 'Success Audit' WHEN 4 THEN 'Échec de l''audit' WHEN 5 THEN '4'
   WHEN 6 THEN '16' WHEN 7 THEN '99' WHEN 8 THEN '  Warning '
   WHEN 9 THEN 'ERREUR SYSTÈME' WHEN 10 THEN 'neúspěšný audit (1)'
   WHEN 11 THEN '監査の成功' WHEN 12 THEN '' WHEN 14 THEN 'Verbose'
   WHEN 15 THEN 'Controllo non riuscito' WHEN 16 THEN 'controllo NON riuscito' END AS type,
 CASE WHEN event_id % 113 = 0 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+', 0) END AS event_code,
 concat('svc-', CAST(user_id % 25 AS STRING)) AS source_name,
 concat(event_type, ' by User ', CAST(user_id AS STRING), ' ', props) AS message
FROM events
"""


def _over(events: DataFrame, text: str) -> DataFrame:
    return events.sparkSession.sql(text.replace("FROM events", "FROM {events}"), events=events)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS_SCHEMA).parquet(sf_dir, pathGlobFilter="events.parquet")


def entries_of(events_frame: DataFrame) -> DataFrame:
    return _over(events_frame, ENTRIES_SQL)


def raw_of(events_frame: DataFrame) -> DataFrame:
    return _over(events_frame, RAW_SQL)
