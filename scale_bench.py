"""How the comparison grows: roster and sheet replicated, evenly and with one hot manager.

Copies get their own IDs.  In the skewed set a third of all rows belongs to one manager,
and a third of the sheet rows are copies of a single row.
Environment: BENCH_SF_DIR, BENCH_CPUS, SCALE_FACTORS (default "1,10,100"), SCALE_DIR
(where the replicated tables go; default a new temporary folder).
"""

import json
import os
import tempfile

from pyspark.sql import functions as F

import bench
from musterline.operators import ranking, reconcile
from musterline.plans import standins


def replicate(df, times, skewed):
    # The source is one small file; spread it, or a single task would write everything.
    out = df.repartition(32).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    out = out.withColumn("employee_id", F.concat(F.col("copy").cast("string"), F.lit("-"), F.trim("employee_id")))
    if skewed:
        hot = F.pmod(F.xxhash64("employee_id"), F.lit(3)) == 0
        out = out.withColumn("manager_id", F.when(hot, "hot").otherwise(F.col("manager_id")))
    return out.drop("copy")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    factors = [int(x) for x in os.environ.get("SCALE_FACTORS", "1,10,100").split(",")]
    root = os.environ.get("SCALE_DIR") or tempfile.mkdtemp(prefix="scale-")
    spark = bench.session(os.environ.get("BENCH_CPUS", "8"))
    results = []
    for times in factors:
        for skewed in (False, True):
            place = f"{root}/{times}-{'skewed' if skewed else 'even'}"
            roster = replicate(standins.roster(spark, sf_dir), times, skewed)
            sheet = replicate(standins.sheet(spark, sf_dir), times, skewed)
            if skewed:
                # Half as many again, all of them one row: a third of the sheet.
                some = sheet.where(F.pmod(F.xxhash64("employee_id"), F.lit(2)) == 0)
                sheet = sheet.unionByName(some.withColumns({"manager_id": F.lit("hot"), "employee_id": F.lit("1-1")}))
            roster.write.mode("overwrite").parquet(place + "/roster")
            sheet.write.mode("overwrite").parquet(place + "/sheet")
            jobs = {
                "summary": lambda r, s: reconcile.summarise(r, s),
                "details": lambda r, s: reconcile.reconcile_with_details(r, s),
                "departments": lambda r, s: reconcile.department_compliance(r, s),
                "top10_per_manager": lambda r, s: ranking.top_per_group(r, ["manager_id"], [F.col("employee_id")], 10),
            }
            row = {"times": times, "skewed": skewed}
            for name, job in jobs.items():
                def query(session, path, job=job):
                    return job(session.read.parquet(path + "/roster"), session.read.parquet(path + "/sheet"))

                bench.seconds(query, spark, place)
                row[name] = round(min(bench.seconds(query, spark, place) for _ in range(2)), 3)
            row["roster_rows"] = spark.read.parquet(place + "/roster").count()
            sheets = spark.read.parquet(place + "/sheet")
            row["sheet_rows"] = sheets.count()
            row["sheet_rows_of_one_id"] = sheets.where("manager_id = 'hot' and employee_id = '1-1'").count()
            row["roster_rows_of_hot"] = spark.read.parquet(place + "/roster").where("manager_id = 'hot'").count()
            results.append(row)
            print(json.dumps(row), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
