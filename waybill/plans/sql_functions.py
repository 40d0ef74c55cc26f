"""The operators as table functions of SQL text.

``register`` makes them over a frame of lines; then ``spark.sql("SELECT * FROM app_timeline(:cluster)", args=...)`` runs
the operator, planned and pruned like any other query. The functions read views of operator results, so no
logic is written a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from waybill.operators import levels, usage

# name: parameters, columns, body
FUNCTIONS = {
    "log_level_counts": (
        "mode STRING DEFAULT 'loose'", "log_level STRING, count BIGINT",
        "SELECT log_level, count FROM waybill_levels WHERE matched = mode AND count > 0",
    ),
    "app_timeline": (
        "cluster STRING DEFAULT NULL", "cluster_id STRING, application_id STRING, app_number STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ",
        "SELECT cluster_id, application_id, app_number, start_time, end_time FROM waybill_timeline WHERE cluster IS NULL OR cluster_id = cluster",
    ),
    "cluster_usage": (
        "least BIGINT DEFAULT 1", "cluster_id STRING, num_applications BIGINT, cluster_first_app TIMESTAMP_NTZ, cluster_last_app TIMESTAMP_NTZ",
        "SELECT cluster_id, num_applications, cluster_first_app, cluster_last_app FROM waybill_clusters WHERE num_applications >= least",
    ),
}


def register(lines: DataFrame) -> list[str]:
    """Make the table functions over these lines, in place of earlier ones of the session; their names."""
    spark = lines.sparkSession
    timeline = usage.app_timeline(lines)
    views = {
        "waybill_levels": levels.level_frame(lines).selectExpr("'loose' AS matched", "*").unionByName(
            levels.level_frame(lines, "strict").selectExpr("'strict' AS matched", "*")
        ),
        "waybill_timeline": timeline,
        "waybill_clusters": usage.cluster_summary(timeline),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(FUNCTIONS)
