"""Distances, nearest facilities, radius totals."""
from __future__ import annotations

from pyspark.sql import functions as F

from sitewise.functions import geo, road
from sitewise.operators import ranking, spatial

from .registry import case
from .tables import role, sql_miles, with_roles


def _targets(facilities):
    return facilities.select("facility_id", F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"),
                             "bed_count", "emergency_services")


_NEAR = f"""
pair AS (SELECT d.demand_id, f.facility_id, f.emergency_services, coalesce(f.bed_count, 0) AS beds,
                {sql_miles('d.latitude', 'd.longitude', 'f.latitude', 'f.longitude')} AS miles
         FROM demand d CROSS JOIN facilities f),
near AS (SELECT demand_id, min(miles) AS miles, arg_min(facility_id, miles) AS facility_id FROM pair GROUP BY demand_id)"""


@case("flagship_ranked_demand", with_roles("demand", "facilities") + "," + _NEAR + """,
scored AS (SELECT d.demand_id, n.facility_id, n.miles,
        n.miles * (1.2::double + rurality * 0.14::double) / (29 + rurality * 23) * 60 AS minutes,
        (rank() OVER (ORDER BY n.miles) + (count(*) OVER (PARTITION BY n.miles) - 1) / 2.0::double) / count(*) OVER () AS distance_need,
        (rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2.0::double) / count(*) OVER () AS population_need
    FROM demand d JOIN near n USING (demand_id))
SELECT demand_id, facility_id, round(minutes, 6) AS minutes,
       round(0.6::double * distance_need + 0.4::double * population_need, 6) AS score
FROM scored ORDER BY 0.6::double * distance_need + 0.4::double * population_need DESC, demand_id LIMIT 50""")
def flagship(spark, folder):
    demand = role(spark, folder, "demand")
    near = spatial.nearest_miles(demand, _targets(role(spark, folder, "facilities")), "demand_id", "facility_id",
                                 "miles", id_name="facility_id")
    frame = demand.select("demand_id", "rurality", "population").join(near, "demand_id").withColumn(
        "minutes", road.drive_minutes("miles", road.detour_factor("rurality"), road.effective_mph("rurality")))
    scored = ranking.add_percentiles(frame, "demand_id", {
        "distance_need": F.col("miles"), "population_need": F.col("population")})
    score = F.col("distance_need") * 0.6 + F.col("population_need") * 0.4
    return (scored.orderBy(score.desc(), "demand_id").limit(50)
            .select("demand_id", "facility_id", F.round("minutes", 6).alias("minutes"), F.round(score, 6).alias("score")))


@case("sp04_nearest_facility", with_roles("demand", "facilities") + "," + _NEAR + """,
er AS (SELECT demand_id, min(miles) AS miles, arg_min(facility_id, miles) AS facility_id FROM pair WHERE emergency_services GROUP BY demand_id)
SELECT n.demand_id, n.facility_id AS nearest_id, round(n.miles, 6) AS nearest_miles,
       e.facility_id AS emergency_id, round(e.miles, 6) AS emergency_miles
FROM near n LEFT JOIN er e USING (demand_id)""")
def nearest_facility(spark, folder):
    demand, targets = role(spark, folder, "demand"), _targets(role(spark, folder, "facilities"))
    every = spatial.nearest_miles(demand, targets, "demand_id", "facility_id", "nearest_miles", id_name="nearest_id")
    emergency = spatial.nearest_miles(demand, targets.where("emergency_services"), "demand_id", "facility_id",
                                      "emergency_miles", id_name="emergency_id")
    return every.join(emergency, "demand_id").select(
        "demand_id", "nearest_id", F.round("nearest_miles", 6).alias("nearest_miles"),
        "emergency_id", F.round("emergency_miles", 6).alias("emergency_miles"))


@case("sp05_radius_totals", with_roles("demand", "facilities") + "," + _NEAR + """
SELECT demand_id, count(*) FILTER (miles <= 10) AS hospitals_10, coalesce(sum(beds) FILTER (miles <= 10), 0)::bigint AS beds_10,
       count(*) FILTER (miles <= 25) AS hospitals_25, coalesce(sum(beds) FILTER (miles <= 25), 0)::bigint AS beds_25,
       count(*) FILTER (miles <= 50) AS hospitals_50, coalesce(sum(beds) FILTER (miles <= 50), 0)::bigint AS beds_50
FROM pair GROUP BY demand_id""")
def radius_totals(spark, folder):
    found = spatial.radius_totals(role(spark, folder, "demand"), _targets(role(spark, folder, "facilities")), "demand_id",
                                  [10, 25, 50], {"hospitals": None, "beds": "bed_count"})
    return found.select("demand_id", *[F.col(f"{n}_{r}").cast("long").alias(f"{n}_{r}")
                                       for r in (10, 25, 50) for n in ("hospitals", "beds")])
