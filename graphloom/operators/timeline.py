"""Routes and engagements as windows and column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH_RADIUS_M = 6_371_000.0

#: Metres per degree of latitude, for grid cells.
DEGREE_M = EARTH_RADIUS_M * 3.141592653589793 / 180

# Speeds in m/s by words in a weapon's name, tried in this order.
WEAPON_SPEEDS = (("torpedo", 40.0), ("missile", 300.0), ("supersonic", 680.0), ("depth charge", 10.0), ("gun", 800.0))
OTHER_SPEED = 200.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def within(points: DataFrame, centers: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of points (id, lat, lon) and centers (center, c_lat, c_lon) within a radius: an equi-join on grid cells, then the distance.

    Cells are a radius high, and centers go to all cells that their circle touches, so nothing is compared beyond neighbours; near the poles a row is one cell.
    """
    step = max(radius_m / DEGREE_M, 1e-6)
    row = lambda lat: F.floor((lat + 90) / step)
    # the width of a cell grows towards the poles; rows whose circles could wrap all longitudes have one cell
    top = F.least(F.lit(89.999), F.abs(F.col("lat_row") * step - 90 + step / 2) + 2.0 * step)
    wide = F.when(top >= 89.9, F.lit(361.0)).otherwise(F.least(F.lit(361.0), step / F.cos(F.radians(top)) * 1.01))
    cell = lambda lon: F.floor((lon + 180) / F.col("width"))
    left = points.withColumn("lat_row", row(F.col("lat"))).withColumn("width", wide).withColumn("lon_cell", cell(F.col("lon"))).drop("width")
    around = centers.withColumn("lat_row", F.explode(F.sequence(row(F.col("c_lat")) - 1, row(F.col("c_lat")) + 1))).withColumn("width", wide)
    near = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: cell((F.col("c_lon") + k * F.col("width") + 540) % 360 - 180))
    last = cell(F.lit(179.999999))
    right = around.withColumn("lon_cell", F.explode(F.array_distinct(F.concat(near, F.when(F.abs(F.col("c_lon")) + 2 * F.col("width") >= 180, F.array(F.lit(0).cast("bigint"), last, last - 1)).otherwise(F.array().cast("array<bigint>")))))).drop("width")
    pairs = left.join(right, ["lat_row", "lon_cell"])
    distance = haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m).drop("lat_row", "lon_cell")


def route_legs(waypoints: DataFrame) -> DataFrame:
    """Waypoints (route, seq, lat, lon, action, start_lat, start_lon, speed) with dist_m, time_s and remaining_s of each leg.

    A leg starts at the waypoint before, the first one at the start. Without a positive speed legs take no time.
    """
    w = Window.partitionBy("route").orderBy("seq")
    legs = waypoints.withColumns({"from_lat": F.coalesce(F.lag("lat").over(w), "start_lat"), "from_lon": F.coalesce(F.lag("lon").over(w), "start_lon")})
    legs = legs.withColumn("dist_m", haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")))
    legs = legs.withColumn("time_s", F.when(F.col("speed") > 0, F.col("dist_m") / F.col("speed")).otherwise(0.0))
    total = F.sum("time_s").over(Window.partitionBy("route"))
    run = F.sum("time_s").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return legs.withColumn("remaining_s", F.greatest(F.lit(0.0), total - run))


def route_totals(legs: DataFrame) -> DataFrame:
    """Per route: legs, total_distance_m, total_time_s, duration (whole seconds, at least one), and its description and cost as text."""
    text = F.format_string("%s(%d,%.0fm,%.1fs)", "action", "seq", "dist_m", "time_s")
    out = legs.groupBy("route").agg(
        F.count(F.lit(1)).alias("legs"), F.sum("dist_m").alias("total_distance_m"), F.sum("time_s").alias("total_time_s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), " ^ ").alias("composed_of"),
    )
    out = out.withColumn("duration", F.greatest(F.lit(1), F.col("total_time_s").cast("bigint")))
    return out.withColumn("cost", F.format_string("%.0fm, %ds", "total_distance_m", "duration"))


def weapon_speed(name: Column) -> Column:
    """By the first word that fits; so a supersonic missile has a missile's speed."""
    out = None
    for word, speed in WEAPON_SPEEDS:
        hit = F.lower(name).contains(word)
        out = F.when(hit, speed) if out is None else out.when(hit, speed)
    return out.otherwise(OTHER_SPEED)


def hit_score(confidence: Column, distance: Column, reach: Column, depth: Column) -> Column:
    base = F.when((distance <= reach) & (reach > 0), confidence * F.greatest(F.lit(0.0), 1 - distance / reach)).otherwise(0.0)
    deep = F.when(depth > 0, F.greatest(F.lit(0.1), 1 - F.least(F.lit(0.9), depth / 1000))).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * deep))


def damage(p: Column) -> Column:
    return F.when(p >= 0.8, "destroyed").when(p >= 0.6, "heavy").when(p >= 0.3, "moderate").when(p > 0, "light").otherwise("none")


def strikes(rows: DataFrame) -> DataFrame:
    """Rows (code, attacker, target, attacker and target lat and lon, target_depth, weapon, weapon_range_m, confidence) with distance, score, damage, time and texts."""
    out = rows.withColumn("distance_m", haversine_m(F.col("attacker_lat"), F.col("attacker_lon"), F.col("target_lat"), F.col("target_lon")))
    out = out.withColumn("in_range", F.col("distance_m") <= F.col("weapon_range_m"))
    out = out.withColumn("hit_probability", hit_score(F.col("confidence"), F.col("distance_m"), F.col("weapon_range_m"), F.col("target_depth")))
    out = out.withColumns({"damage_level": damage(F.col("hit_probability")), "total_time_s": F.col("distance_m") / weapon_speed(F.col("weapon"))})
    rounds = F.when(F.col("hit_probability") > 0.3, 1).otherwise(2)
    return out.withColumns({"duration": F.greatest(F.lit(1), F.col("total_time_s").cast("bigint")), "cost": F.format_string("%.0fm, %.0fs, %d rounds", F.col("distance_m"), F.col("total_time_s"), rounds)})


def route_rules(totals: DataFrame) -> DataFrame:
    """Totals with columns entity and speed added by the caller, and texts of the route's precondition and effect as rule atoms."""
    before = F.format_string(":Entity(%s) ^ moves(%s, %s) ^ hasSpeed(%s, %.0f) ^ hasStatus(%s, 'active')", "entity", "entity", "route", "entity", "speed", "entity")
    after = F.format_string(":Patrol(%s) ^ hasStatus(%s, 'done') ^ hasCovered(%s, true) ^ hasDuration(%s, %d)", "route", "route", "route", "route", "duration")
    return totals.withColumns({"precondition": before, "effect": after})


def strike_rules(scored: DataFrame) -> DataFrame:
    """Scored strikes with texts of precondition, effect and parts as rule atoms."""
    before = F.format_string(":Entity(%s) ^ :Entity(%s) ^ strikes(%s, %s, %s) ^ hasWeapon(%s, '%s') ^ hasRange(%s, %.0f) ^ distance(%s, %s, %.0f)", "attacker", "target", "attacker", "target", "code", "attacker", "weapon", "weapon", "weapon_range_m", "attacker", "target", "distance_m")
    status = F.when(F.col("hit_probability") > 0, "done").otherwise("out of range")
    after = F.format_string(":Strike(%s) ^ hasStatus(%s, '%s') ^ hasHitProbability(%s, %.2f) ^ hasDamage(%s, '%s')", F.col("code"), F.col("code"), status, F.col("code"), F.col("hit_probability"), F.col("code"), F.col("damage_level"))
    parts = F.format_string("lock(%s,%s,%.0fm) ^ launch(%s,%s,%.1fs) ^ hit(%s,%.1f%%) ^ damage(%s,%s)", F.col("attacker"), F.col("target"), F.col("distance_m"), F.col("weapon"), F.col("code"), F.col("total_time_s"), F.col("target"), F.col("hit_probability") * 100, F.col("target"), F.col("damage_level"))
    return scored.withColumns({"precondition": before, "effect": after, "composed_of": parts})
