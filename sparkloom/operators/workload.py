"""What is to be generated and by whom: databases, the scenario grid, quotas, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Databases kept for evaluation, by benchmark.
EVALUATION = {
    "spider": "battle_death car_1 concert_singer course_teach cre_Doc_Template_Mgt dog_kennels employee_hire_evaluation flight_2 museum_visit network_1 news_report perpetual_student riding_club sports_competition voter_1 world_1 tvshow student_1 storm_record tracking_software_problems documents_products gas_company game_injury apartment_rentals loan_1 student_2 tracking_grants_for_research shipping_records assets_maintenance bike_1 manufacturer climbing railway icfp_1 local_govt_in_detail race_track insurance_policies farm musical games_1 program_exhibition museum preschool sports_1 public_review wrestler ship_1 hockey_1 codebase_subsite debate film_rank feeding_the_homeless architecture company_1 device election school_busines coffee_1 swimming".split(),
    "bird": "california_schools card_games codebase_community debit_card_specializing european_football_2 financial formula_1 student_club superhero thrombosis_prediction toxicology".split(),
    "spider2": [],
    "ehrsql": [],
    "science_benchmark": [],
}
#: Scenarios with weights, their parts with weights.
SCENARIOS = (
    ("data_exploration", 0.30, (("record_lookup", 0.4), ("sorting_and_pagination", 0.3), ("distinct_and_dedup", 0.3))),
    ("aggregation_statistics", 0.35, (("group_by_aggregation", 0.4), ("having_filtering", 0.3), ("distribution_analysis", 0.3))),
    ("multi_table_query", 0.35, (("inner_join_lookup", 0.35), ("multi_table_aggregation", 0.35), ("set_operations", 0.30))),
)
LEVELS = ("simple", "moderate", "complex", "expert")
#: Share of each complexity level.
LEVEL_SHARES = (0.30, 0.40, 0.20, 0.10)
#: Use cases with weights by part, one line for each level from simple to expert.
USE_CASES: dict[str, tuple[dict[str, float], ...]] = {
    "record_lookup": (
        {"data_viewing": 0.5, "data_filtering": 0.5},
        {"data_filtering": 0.6, "data_viewing": 0.4},
        {"data_filtering": 0.5, "relationship_analysis": 0.3, "conditional_logic": 0.2},
        {"conditional_logic": 0.4, "relationship_analysis": 0.3, "advanced_analysis": 0.3},
    ),
    "sorting_and_pagination": (
        {"data_viewing": 0.4, "ranking_analysis": 0.6},
        {"ranking_analysis": 0.5, "data_filtering": 0.5},
        {"ranking_analysis": 0.4, "conditional_logic": 0.3, "data_aggregation": 0.3},
        {"ranking_analysis": 0.3, "advanced_analysis": 0.4, "trend_analysis": 0.3},
    ),
    "distinct_and_dedup": (
        {"data_viewing": 0.5, "data_filtering": 0.5},
        {"data_aggregation": 0.5, "data_filtering": 0.5},
        {"data_aggregation": 0.4, "conditional_logic": 0.3, "relationship_analysis": 0.3},
        {"advanced_analysis": 0.4, "multi_dimensional_analysis": 0.3, "data_aggregation": 0.3},
    ),
    "group_by_aggregation": (
        {"data_viewing": 0.3, "data_aggregation": 0.7},
        {"data_aggregation": 0.7, "data_filtering": 0.3},
        {"data_aggregation": 0.4, "ranking_analysis": 0.3, "conditional_logic": 0.3},
        {"advanced_analysis": 0.4, "multi_dimensional_analysis": 0.3, "data_aggregation": 0.3},
    ),
    "having_filtering": (
        {"data_aggregation": 0.6, "data_filtering": 0.4},
        {"data_aggregation": 0.6, "conditional_logic": 0.4},
        {"conditional_logic": 0.4, "data_aggregation": 0.3, "ranking_analysis": 0.3},
        {"advanced_analysis": 0.5, "conditional_logic": 0.3, "multi_dimensional_analysis": 0.2},
    ),
    "distribution_analysis": (
        {"data_aggregation": 0.5, "data_viewing": 0.5},
        {"data_aggregation": 0.5, "ranking_analysis": 0.5},
        {"data_aggregation": 0.3, "advanced_analysis": 0.4, "conditional_logic": 0.3},
        {"advanced_analysis": 0.5, "multi_dimensional_analysis": 0.3, "trend_analysis": 0.2},
    ),
    "inner_join_lookup": (
        {"data_viewing": 0.3, "relationship_analysis": 0.7},
        {"relationship_analysis": 0.5, "data_filtering": 0.3, "data_viewing": 0.2},
        {"relationship_analysis": 0.4, "data_aggregation": 0.3, "conditional_logic": 0.3},
        {"relationship_analysis": 0.3, "advanced_analysis": 0.4, "recursive_analysis": 0.3},
    ),
    "multi_table_aggregation": (
        {"relationship_analysis": 0.4, "data_aggregation": 0.6},
        {"data_aggregation": 0.4, "relationship_analysis": 0.4, "ranking_analysis": 0.2},
        {"data_aggregation": 0.3, "relationship_analysis": 0.3, "ranking_analysis": 0.2, "conditional_logic": 0.2},
        {"advanced_analysis": 0.4, "multi_dimensional_analysis": 0.3, "relationship_analysis": 0.3},
    ),
    "set_operations": (
        {"relationship_analysis": 0.5, "data_filtering": 0.5},
        {"relationship_analysis": 0.5, "data_aggregation": 0.3, "data_filtering": 0.2},
        {"relationship_analysis": 0.4, "conditional_logic": 0.3, "advanced_analysis": 0.3},
        {"advanced_analysis": 0.4, "recursive_analysis": 0.3, "relationship_analysis": 0.3},
    ),
}


class LeakageError(ValueError):
    """Training data would be made from an evaluation database."""


def assert_train_only(benchmark: str, database: str) -> None:
    if database in EVALUATION.get(benchmark, ()):
        raise LeakageError(f"{database} is an evaluation database of {benchmark}")


def evaluation_databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, d) for b, ds in EVALUATION.items() for d in ds], "benchmark string, database string")


def train_databases(databases: DataFrame) -> DataFrame:
    """(benchmark, database) without those kept for evaluation."""
    return databases.join(F.broadcast(evaluation_databases(databases.sparkSession)), ["benchmark", "database"], "left_anti")


def list_databases(spark: SparkSession, root: str, benchmark: str) -> DataFrame:
    """Databases below root/<benchmark>/databases that hold <name>/<name>.sqlite and may be used for training."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sqlite").load(f"{root}/{benchmark}/databases").select("path")
    name = F.regexp_extract("path", r"/([^/]+)/([^/]+)\.sqlite$", 1)
    found = files.where(name == F.regexp_extract("path", r"/([^/]+)/([^/]+)\.sqlite$", 2)).select(F.lit(benchmark).alias("benchmark"), name.alias("database"))
    return train_databases(found).orderBy("database")


def grid(spark: SparkSession) -> DataFrame:
    """The 36 combinations in stated order: (position, main_scenario, sub_scenario, complexity_level, weight)."""
    rows = [(s, p, i + 1, w * v * LEVEL_SHARES[i]) for s, w, parts in SCENARIOS for p, v in parts for i in range(4)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "position int, main_scenario string, sub_scenario string, complexity_level int, weight double")


def use_cases(spark: SparkSession) -> DataFrame:
    """(sub_scenario, complexity_level, use_case, weight, low, high): shares of use cases with their running bounds."""
    rows = []
    for part, levels in USE_CASES.items():
        for i, weights in enumerate(levels):
            low = 0.0
            for name, w in weights.items():
                rows.append((part, i + 1, name, w, round(low, 6), round(low + w, 6)))
                low += w
    return spark.createDataFrame(rows, "sub_scenario string, complexity_level int, use_case string, weight double, low double, high double")


def complexity_shares(spark: SparkSession) -> DataFrame:
    """(main_scenario, complexity_level, share): how the tasks of a scenario are spread over levels."""
    rows = grid(spark).groupBy("main_scenario", "complexity_level").agg(F.sum("weight").alias("w"))
    return rows.select("main_scenario", "complexity_level", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("main_scenario")), 6).alias("share"))


def draw(key: str, seed: int):
    """A number in [0, 1) that depends on a key and a seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) * F.lit(2.0**-53)


def resolve_use_cases(tasks: DataFrame, seed: int = 1, key: str = "task_id") -> DataFrame:
    """tasks (key, sub_scenario, complexity_level) with a use case drawn by the stated weights; unknown parts view data."""
    u = tasks.withColumn("u", draw(key, seed))
    cases = F.broadcast(use_cases(tasks.sparkSession).drop("weight"))
    hit = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
    joined = u.join(cases, ["sub_scenario", "complexity_level"], "left").where(hit | F.col("low").isNull())
    return joined.withColumn("use_case", F.coalesce("use_case", F.lit("data_viewing"))).drop("low", "high", "u")


def tasks(spark: SparkSession, count: int, start: int = 0, seed: int = 1) -> DataFrame:
    """``count`` tasks from number ``start`` on: first each combination once, in order, then by weight; bounded, and no restart between batches."""
    combos = grid(spark).withColumn("high", F.sum("weight").over(Window.orderBy("position"))).withColumn("low", F.col("high") - F.col("weight"))
    n = combos.count()
    numbers = spark.range(start, start + count).withColumnRenamed("id", "task_id")
    once = numbers.where(F.col("task_id") < n).join(F.broadcast(combos), F.col("task_id") == F.col("position"))
    u = draw("task_id", seed)
    more = numbers.where(F.col("task_id") >= n).withColumn("u", u).join(F.broadcast(combos), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    columns = ["task_id", "main_scenario", "sub_scenario", "complexity_level"]
    return resolve_use_cases(once.select(columns).unionByName(more.select(columns)), seed)


def even_split(databases: DataFrame, total: int) -> DataFrame:
    """databases (position from 0) with quota: total // n, one more for the first total % n."""
    n = databases.agg(F.count("*").alias("n"))
    q = F.expr(f"int({total} div n)") + F.when(F.col("position") < F.lit(total) % F.col("n"), 1).otherwise(0)
    return databases.crossJoin(F.broadcast(n)).withColumn("quota", q.cast("long")).drop("n")


def shard(databases: DataFrame, index: int, count: int) -> DataFrame:
    """Every count-th database from index on, by position."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return databases.where(F.col("position") % count == index)


def pending(quotas: DataFrame, done: DataFrame) -> DataFrame:
    """quotas (database, quota) with what is missing, from records done (database); finished databases go."""
    n = done.groupBy("database").agg(F.count("*").alias("made"))
    left = F.col("quota") - F.coalesce("made", F.lit(0))
    return quotas.join(n, "database", "left").withColumn("missing", left).where("missing > 0").drop("made")
