"""Packets from the driver's events table: each event is one TCP SYN, forty a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs in Spark and in DuckDB alike; {events} is the events table.
SQL = """
SELECT event_id + 1 AS no, CAST(event_id AS DOUBLE) / 40 AS timestamp,
  concat('10.0.0.', CAST(u AS STRING)) AS src, dst,
  CASE event_type WHEN 'view' THEN 'HTTPS' WHEN 'click' THEN 'HTTP' WHEN 'error' THEN 'SSH' WHEN 'signup' THEN 'SMB' ELSE 'TCP' END AS protocol,
  CAST(54 + length(event_type) AS INT) AS length, event_type AS info, 40000 + u AS src_port, dst_port,
  CASE WHEN k % 10 = 0 THEN 20 ELSE NULL END AS vlan_id,
  unhex(concat('000000000001', '02000000000', hex(u), '0800', '4500', lpad(hex(40 + length(event_type)), 4, '0'), '0000', '4000', '4006', '0000',
    '0A0000', lpad(hex(u), 2, '0'), dst_hex, lpad(hex(40000 + u), 4, '0'), lpad(hex(dst_port), 4, '0'),
    lpad(hex(event_id), 8, '0'), '00000000', '50', '02', 'FAF0', '0000', '0000', hex(event_type))) AS bytes
FROM (SELECT event_id, event_type, u, k,
    CASE WHEN event_type = 'purchase' THEN concat('203.0.113.', CAST(k % 2 + 1 AS STRING)) ELSE concat('10.0.1.', CAST(k % 25 + 1 AS STRING)) END AS dst,
    CASE WHEN event_type = 'purchase' THEN concat('CB0071', lpad(hex(k % 2 + 1), 2, '0')) ELSE concat('0A0001', lpad(hex(k % 25 + 1), 2, '0')) END AS dst_hex,
    CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'error' THEN 22 WHEN 'signup' THEN 445 ELSE 1000 + k END AS dst_port
  FROM (SELECT event_id, event_type, CAST(user_id % 6 + 1 AS INT) AS u, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e) f
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
