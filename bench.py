"""Times the headline queries and the phases of imputation; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from ringspark.ml.models import LinearRegression
from ringspark.ml.triple import Triple
from ringspark.operators.aggregate import cofactor, sum_triple
from ringspark.functions.ring import to_cofactor
from ringspark.plans import catalogue as C
from ringspark.plans.mice import MASK, init
from ringspark.session import local_session, ship

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "cofactor_numeric cofactor_mixed cofactor_grouped nb_agg_grouped sum_of_lift multiply_keyed factorized_join_2way factorized_join_3way "
    "factorized_many_to_many linreg_predict nb_predict lda_predict_mixed qda_predict_mixed null_pattern_partition mice_baseline mice_low mice_high"
).split()


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = ship(local_session(CPUS, int(CPUS)))
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    queries = C.queries()
    run(queries["cofactor_mixed"](spark, SF))  # compiles what all others use
    for name in HEADLINE:
        out[name] = timed(lambda n=name: run(queries[n](spark, SF)))
    # The phases of one imputation step.
    state: dict = {}
    num, cat = C.NUM, ["rf", "ls"]
    holes = C.holes(spark, SF).select("id", *num, *cat)
    out["phase_prepare"] = timed(lambda: state.update(table=init(holes, ["q", "d"], ["rf"]).persist()) or state["table"].count())
    table = state["table"]
    gone = F.col(MASK).bitwiseAND(F.lit(1)) != 0
    out["phase_cofactor"] = timed(lambda: state.update(full=Triple.from_row(cofactor(table, num, cat).first()["triple"])))
    out["phase_delta_cofactor"] = timed(lambda: state.update(delta=Triple.from_row(cofactor(table.where(gone), num, cat).first()["triple"])))
    out["phase_train"] = timed(lambda: state.update(model=LinearRegression.fit(state["full"] - state["delta"], 0, include_variance=True)))
    value = state["model"].predict(num[1:], cat)
    out["phase_update"] = timed(lambda: run(table.withColumn("q", F.when(gone, value).otherwise(F.col("q")))))
    out["fused"] = timed(lambda: cofactor(table, num, cat).collect())
    out["sum_of_lifts"] = timed(lambda: sum_triple(table.select(to_cofactor(num, cat).alias("triple")), "triple").collect())
    print(json.dumps({"metric": "total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
