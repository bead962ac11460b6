"""Validation of a corrected field against stations that it has not seen.

Each station in turn is left out of the vertical field; what the field then
predicts around it, and in the reference area, is taken off the observed looks,
and the rest is compared with the station's horizontal motion.  Supports and
weights depend on positions and frozen errors alone, so they are found once; an
epoch is a sum in the task that found them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dense
from tessera.operators.reference import LOOK
from tessera.operators.spatial import adaptive_support, radius_join
from tessera.runtime import cut_lineage

#: Targets that one group solves at most, and rows that it returns.
TARGETS, RESULTS = 4096, 1 << 20

#: Targets of one set of stations from which on a common factorisation pays.
SHARED = 4


def _solve_held_out(family: str, xy: np.ndarray, sigma: np.ndarray, at: np.ndarray, members: list[np.ndarray], held: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, station, weight) by target, and the targets' variances (NaN if not determined).

    ``members`` are the stations of each target, ``held`` the one left out or -1.
    Targets whose stations together with the one left out are the same set share one
    factorisation if they are many; the others are solved in stacks of equally many
    stations.
    """
    variance = np.full(len(at), np.nan)
    sets: dict[bytes, list[int]] = {}
    for i, m in enumerate(members):
        sets.setdefault(np.unique(np.append(m, held[i]) if held[i] >= 0 else m).tobytes(), []).append(i)
    alone: dict[int, list[int]] = {}
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for key, rows in sets.items():
        if len(rows) < SHARED:
            for i in rows:
                alone.setdefault(len(members[i]), []).append(i)
            continue
        own, rows = np.frombuffer(key, dtype=np.int64), np.array(rows)
        place = np.where(held[rows] >= 0, np.searchsorted(own, held[rows]), -1)
        w, variance[rows] = dense.held_out_weights(family, xy[own], sigma[own], at[rows], place, **model)
        used = np.ones(w.shape, dtype=bool)
        used[np.flatnonzero(place >= 0), place[place >= 0]] = False
        used[np.isnan(variance[rows])] = False
        row, column = np.nonzero(used)
        found.append((rows[row], own[column], w[row, column]))
    for n, rows in alone.items():
        rows, use = np.array(rows), np.array([members[i] for i in rows])
        w, error, known = dense.stacked_kriging_weights(family, xy[use], sigma[use], at[rows], **model)
        rows, use, w = rows[known], use[known], w[known]
        variance[rows] = error[known]
        found.append((np.repeat(rows, n), use.ravel(), w.ravel()))
    target, station, w = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(target, kind="stable")
    return target[order], station[order], w[order], variance


def held_out_field(targets: DataFrame, stations: DataFrame, values: DataFrame, family: str, *, reach: float, length: float, sill: float, nugget: float) -> DataFrame:
    """(t_id, epoch, predicted, sigma, n) of targets that leave out a station, at epochs with a value of each of their stations.

    targets: id, x, y, held (a station or null), station_ids (not empty, within ``reach``,
    without the held one); stations: id, x, y, sigma; values: id, epoch, value.

    Targets meet the stations of the cells around them, not each of its own: a group
    is a cell, or a share of its targets if they are many.  It solves their weights
    once and sums every epoch with them, so neither weights nor products of weights
    and values are shuffled.
    """
    kinds, size = dict(targets.dtypes) | {"epoch": dict(values.dtypes)["epoch"]}, 2 * reach
    model = {"length": length, "sill": sill, "nugget": nugget}
    epochs = values.agg(F.approx_count_distinct("epoch")).first()[0]
    per = max(1, min(TARGETS, RESULTS // max(epochs, 1)))
    cell = ["__cx", "__cy"]
    t = targets.select(F.col("id").alias("t_id"), "x", "y", F.size("station_ids").alias("n"), F.when(F.col("held").isNull(), F.col("station_ids")).otherwise(F.concat("station_ids", F.array("held"))).alias("members"))
    t = t.withColumns({c: F.floor(F.col(v) / size).cast("long") for c, v in zip(cell, "xy", strict=True)})
    shares = cut_lineage(t.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / per).alias("__shares")))
    t = t.join(shares, cell).withColumn("__share", F.pmod(F.xxhash64("t_id"), F.col("__shares"))).drop("__shares")
    s = stations.select("id", "x", "y", "sigma")
    for c, v in zip(cell, "xy", strict=True):
        at = F.floor(F.col(v) / size).cast("long")
        s = s.withColumn(c, F.explode(F.sequence(at - 1, at + 1)))
    s = s.join(shares, cell).withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__shares") - 1))).drop("__shares")
    s = s.join(values.where(F.col("value").isNotNull()).select("id", "epoch", "value"), "id")  # a station without any value gives no epoch

    def solve(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        code, ids = pd.factorize(s["id"])
        first = np.unique(code, return_index=True)[1]
        xy, sigma = s[["x", "y"]].to_numpy(float)[first], s["sigma"].to_numpy(float)[first]
        when, epoch = pd.factorize(s["epoch"])
        v, seen = np.zeros((len(epoch), len(ids))), np.zeros((len(epoch), len(ids)), dtype=int)
        np.add.at(seen, (when, code), 1)
        v[when, code] = s["value"].to_numpy(float)
        lists = t["members"].tolist()
        place = pd.Index(ids).get_indexer(np.concatenate(lists)) if lists else np.empty(0, dtype=np.int64)
        parts = np.split(place.astype(np.int64), np.cumsum([len(m) for m in lists])[:-1]) if lists else []
        n = t["n"].to_numpy()
        members = [p[:k] for p, k in zip(parts, n, strict=True)]
        held = np.array([p[k] if len(p) > k else -1 for p, k in zip(parts, n, strict=True)], dtype=np.int64)
        whole = np.flatnonzero([(m >= 0).all() for m in members])
        ids_t, n, at = t["t_id"].to_numpy()[whole], n[whole], t[["x", "y"]].to_numpy(float)[whole]
        target, station, w, variance = _solve_held_out(family, xy, sigma, at, [members[i] for i in whole], held[whole], model)
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])[: len(target)])
        rows, out = target[first], []
        for e in range(len(epoch)) if len(rows) else ():
            full = np.add.reduceat((seen[e, station] == 1).astype(int), first) == n[rows]
            known = v[e, (seen[e] == 1) & np.isfinite(v[e])]
            middle = known.mean() if len(known) else 0.0  # weights sum to one: less is lost to rounding
            total, kept = middle + np.add.reduceat(w * (v[e, station] - middle), first)[full], rows[full]
            out.append((ids_t[kept], np.full(len(kept), e), total, np.sqrt(variance[kept]), n[kept]))
        if not out:
            return pd.DataFrame({"t_id": ids_t[:0], "epoch": epoch[:0], "predicted": np.empty(0), "sigma": np.empty(0), "n": n[:0]})
        t_id, e, total, error, n = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"t_id": t_id, "epoch": epoch[e], "predicted": total, "sigma": error, "n": n})

    schema = f"t_id {kinds['id']}, epoch {kinds['epoch']}, predicted double, sigma double, n int"
    keys = [*cell, "__share"]
    return t.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(solve, schema)


def station_validation(
    pixels: DataFrame,
    reference: DataFrame,
    observed: DataFrame,
    stations: DataFrame,
    motion: DataFrame,
    *,
    reference_station,
    radii: Sequence[float],
    family: str,
    length: float,
    sill: float,
    nugget: float,
    look_sigma: float,
    least_pixels: int = 5,
    least_reference: int = 25,
    least_epochs: int = 1,
    **support_options,
) -> tuple[DataFrame, DataFrame]:
    """Rows (station, epoch) of the horizontal look against the station's own, and excluded stations with the reason.

    pixels: station, id, x, y and the look, of the disk around each station;
    reference: id, x, y and the look of the reference area; observed: id, epoch,
    value of the pixels; stations: id, x, y, sigma (frozen error of the vertical);
    motion: id, epoch, east, north, up, sigma_e, sigma_n.

    The vertical field at a station's pixels and at the reference area comes from all
    other stations.  The median of its look over the reference area is its level;
    the observed look minus the levelled vertical look, as a median over the pixels,
    is compared with the station's horizontal motion in that look relative to the
    reference station's.  An epoch counts with ``least_pixels`` pixels and
    ``least_reference`` reference pixels, a station with ``least_epochs`` epochs.
    A station's level is its own, but leaving it out changes the field only at
    reference pixels within the widest radius of it.  So each pixel is solved once
    with all stations and once without each station near it; stations that no
    reference pixel is near to have one level.
    """
    look_e, look_n, look_u = LOOK
    reach = max(radii)
    tested = stations.where(F.col("id") != F.lit(reference_station))
    own = pixels.join(tested.select(F.col("id").alias("held")), F.col("station") == F.col("held")).select("held", F.col("id").alias("pixel"), "x", "y", *LOOK, F.lit(False).alias("area"))
    area = reference.dropna(subset=list(LOOK)).select(F.col("id").alias("pixel"), "x", "y", *LOOK)
    near = radius_join(area, tested.join(own.select(F.col("held").alias("id")).distinct(), "id", "left_semi").select("id", "x", "y"), reach)
    near = cut_lineage(near.select(F.col("s_id").alias("held"), *[F.col(f"t_{c}").alias(c) for c in area.columns], F.lit(True).alias("area")).dropDuplicates(["held", "pixel"]))
    level_all = area.select(F.lit(None).cast(dict(stations.dtypes)["id"]).alias("held"), *area.columns, F.lit(True).alias("area"))
    whole = cut_lineage(own.unionByName(near).unionByName(level_all).withColumn("id", F.monotonically_increasing_id()))
    support = adaptive_support(whole.select("id", "x", "y", "held"), stations.select("id", "x", "y"), radii, without="held", **support_options)
    whole = cut_lineage(whole.join(support.select(F.col("t_id").alias("id"), "station_ids", F.col("radius").alias("reach")), "id"))
    ups = motion.select("id", "epoch", F.col("up").alias("value"))
    vertical = held_out_field(whole, stations, ups, family, reach=reach, length=length, sill=sill, nugget=nugget)
    field = vertical.join(whole.drop("station_ids").withColumnRenamed("id", "t_id"), "t_id")
    field = cut_lineage(field.withColumns({"__v": F.col(look_u) * F.col("predicted"), "__s": F.abs(look_u) * F.col("sigma")}))
    at_area = field.where("area").select("held", "pixel", "epoch", "__v", "__s")
    level_of = [F.median("__v").alias("level"), F.median("__s").alias("level_sigma"), F.count(F.lit(1)).alias("n_reference")]
    untouched = at_area.where("held IS NULL").drop("held")
    close = near.select("held").distinct()
    others = untouched.withColumn("__j", F.lit(0)).join(F.broadcast(close.withColumn("__j", F.lit(0))), "__j").drop("__j").join(near.select("held", "pixel"), ["held", "pixel"], "left_anti")
    level = at_area.where("held IS NOT NULL").unionByName(others).groupBy("held", "epoch").agg(*level_of)
    common = untouched.groupBy("epoch").agg(*level_of)
    seen = observed.where(F.col("value").isNotNull()).select(F.col("id").alias("pixel"), "epoch", F.col("value").alias("__o"))
    at = field.where(~F.col("area")).dropna(subset=[look_e, look_n]).join(seen, ["pixel", "epoch"])
    groups = at.groupBy("held", "epoch").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.median("__o").alias("observed"), F.median("__v").alias("__vertical"), F.median(F.col("__o") - F.col("__v")).alias("__rest"),
        F.median(look_e).alias("__e"), F.median(look_n).alias("__n"), F.median("__s").alias("__s"), F.median("predicted").alias("up_predicted"), F.min("n").alias("n_support"), F.max("reach").alias("reach"),
    ).where(F.col("n_pixels") >= least_pixels)
    levels = ["level", "level_sigma", "n_reference"]
    groups = groups.join(close.withColumn("__close", F.lit(True)), "held", "left")
    groups = groups.join(level, ["held", "epoch"], "left").join(common.withColumnsRenamed({c: f"__c_{c}" for c in levels}), "epoch", "left")
    groups = groups.withColumns({c: F.when(F.col("__close"), F.col(c)).otherwise(F.col(f"__c_{c}")) for c in levels}).where(F.col("n_reference") >= least_reference)
    groups = groups.withColumns({"vertical": F.col("__vertical") - F.col("level"), "horizontal": F.col("__rest") + F.col("level")})
    base = F.broadcast(reference.agg(F.median(look_e).alias("__re"), F.median(look_n).alias("__rn")))
    names = ("east", "north", "sigma_e", "sigma_n")
    here = motion.select(F.col("id").alias("held"), "epoch", *[F.col(c).alias(f"__{c}") for c in names], F.col("up").alias("up_observed"))
    there = motion.where(F.col("id") == F.lit(reference_station)).select("epoch", *[F.col(c).alias(f"__r_{c}") for c in names])
    j = groups.join(here, ["held", "epoch"]).join(there, "epoch").join(base, F.lit(True))
    projected = lambda e, n, a, b: F.col(e) * F.col(a) + F.col(n) * F.col(b)
    error2 = lambda e, n, a, b: F.pow(F.col(e) * F.col(a), 2) + F.pow(F.col(n) * F.col(b), 2)
    horizontal_sigma = F.sqrt(F.lit(look_sigma**2) + F.col("__s") * F.col("__s") + F.col("level_sigma") * F.col("level_sigma"))
    station_sigma = F.sqrt(error2("__e", "__n", "__sigma_e", "__sigma_n") + error2("__re", "__rn", "__r_sigma_e", "__r_sigma_n"))
    rows = j.withColumns(
        {"horizontal_sigma": horizontal_sigma, "station": projected("__e", "__n", "__east", "__north") - projected("__re", "__rn", "__r_east", "__r_north"), "station_sigma": station_sigma}
    )
    rows = rows.withColumns({"residual": F.col("horizontal") - F.col("station"), "total_sigma": F.hypot("horizontal_sigma", "station_sigma"), "up_residual": F.col("up_predicted") - F.col("up_observed")})
    rows = rows.withColumn("standardized", F.col("residual") / F.nullif(F.col("total_sigma"), F.lit(0.0)))
    out = rows.select(
        F.col("held").alias("id"), "epoch", "n_pixels", "n_reference", "n_support", "reach", "observed", "vertical", "horizontal", "horizontal_sigma", "station", "station_sigma", "residual", "total_sigma",
        "standardized", "up_observed", "up_predicted", "up_residual",
    )
    out = cut_lineage(out)
    epochs = out.groupBy("id").agg(F.count(F.lit(1)).alias("__epochs"))
    supported = whole.where("held IS NOT NULL").groupBy(F.col("held").alias("id")).agg(F.count_if(~F.col("area")).alias("__here"), F.count_if("area").alias("__left"))
    far = whole.where("area AND held IS NULL").select("pixel")
    hidden = near.join(far, "pixel").groupBy(F.col("held").alias("id")).agg(F.count(F.lit(1)).alias("__hidden"))
    supported = supported.join(hidden, "id", "left").join(F.broadcast(far.agg(F.count(F.lit(1)).alias("__all"))), F.lit(True))
    supported = supported.select("id", "__here", (F.col("__all") - F.coalesce("__hidden", F.lit(0)) + F.col("__left")).alias("__there"))
    disk = own.groupBy(F.col("held").alias("id")).agg(F.count(F.lit(1)).alias("__disk"))
    state = stations.select("id").join(disk, "id", "left").join(supported, "id", "left").join(epochs, "id", "left").fillna(0, ["__disk", "__here", "__there", "__epochs"])
    reason = (
        F.when(F.col("id") == F.lit(reference_station), "reference station").when(F.col("__disk") < least_pixels, "too few pixels").when(F.col("__here") == 0, "no support without it")
        .when(F.col("__there") < least_reference, "no reference support without it").when(F.col("__epochs") < least_epochs, "too few epochs")
    )
    excluded = state.select("id", reason.alias("reason")).where("reason IS NOT NULL")
    return out.join(excluded.select("id"), "id", "left_anti"), excluded
