"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestat import plans  # noqa: E402
from lodestat.session import local_session  # noqa: E402

HEADLINES = [
    "profile", "describe", "moments", "histogram", "crosstab", "group_stats", "box_stats", "corr_pearson", "corr_spearman",
    "corr_kendall", "missing_by_column", "quality_score", "outliers_iqr", "outlier_consensus", "mann_whitney", "chi_square",
    "kruskal_wallis", "scale_standard", "encode_label", "select_k_best_f_classif", "kmeans", "train_regressor_linear",
    "classification_metrics", "roc_auc", "regression_metrics", "rolling_band", "autocorrelation", "decompose", "periodogram",
    "forecast_linear", "clean_text", "text_features", "keywords", "sentiment", "tfidf_vectors", "near_duplicates", "entities",
    "monitor_metrics_1h", "train_classifier", "batch_predict", "topics_lda", "outliers_lof", "dbscan", "embedding_similarity",
    "stationarity", "forecast_arima", "seasonality_strength", "stream_running_stats", "stream_last_n_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start-up is not part of the figures
    wanted = sys.argv[1:] or HEADLINES
    times = {}
    for name in wanted:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
