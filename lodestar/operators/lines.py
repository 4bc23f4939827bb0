"""Line editing: chains of lines merged by pointers that double, lines cut at places, offset, and freed of small bends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import durable
from ..functions import geometry as Y

c = F.col


def merge_lines(lines: DataFrame, rounds: int = 64) -> DataFrame:
    """(first, n, line) of lines (id, line) joined where exactly two ends meet; `first` is the least id of a merged line, n how many it is made of.

    Each line is there in both directions; each directed line points at the one that goes on from its end. Pointers double in length each round, so a chain of n
    lines is named and ordered in log n joins, and no task holds a chain before it is put together. A merged line runs so that its first point is the
    lesser of its ends; a ring begins with its least line, in that line's own direction. Lines of fewer than two points are left out; where other than two ends meet, lines end.
    """
    good = lines.where("size(line) > 1").select("id", "line")
    first, last = F.get("line", F.lit(0)), F.element_at("line", -1)
    ends = good.select("id", F.explode(F.array(F.struct(first["x"].alias("x"), first["y"].alias("y"), F.lit(False).alias("back")), F.struct(last["x"].alias("x"), last["y"].alias("y"), F.lit(True).alias("back")))).alias("e")).select("id", "e.*")
    # a directed line that begins here: forward at its first point, backward at its last
    joints = ends.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 2").select("x", "y")
    start = ends.join(joints, ["x", "y"]).select("x", "y", "id", "back")
    end = start.select("x", "y", c("id").alias("from"), (~c("back")).alias("from_back"))
    node = lambda i, b: F.struct(c(i).alias("id"), c(b).alias("back"))
    # arriving at a joint one goes on with the other end that meets there
    step = end.join(start, ["x", "y"]).where((c("from") != c("id")) | (c("from_back") == c("back"))).select(node("from", "from_back").alias("node"), node("id", "back").alias("follows"))
    # a line that closes on itself follows itself
    step = step.groupBy("node").agg(F.min("follows").alias("follows"))
    nodes = good.select("id", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select(node("id", "back").alias("node"))
    state = durable(nodes.join(step, "node", "left").select("node", c("follows").alias("jump"), c("node").alias("low")))
    follows = durable(state.select("node", c("jump").alias("follows")))
    # on a chain pointers end, fewer being left after each round; those of rings never do, and the least node of each is found meanwhile
    running = None
    for _ in range(rounds):
        far = state.select(c("node").alias("jump"), c("jump").alias("then"), c("low").alias("other"))
        new = durable(state.join(far, "jump", "left").select("node", c("then").alias("jump"), F.least("low", F.coalesce("other", "low")).alias("low"), (F.coalesce("other", "low") < c("low")).alias("moved")))
        now, moved = new.agg(F.count("jump"), F.count_if("moved")).first()
        state = new.drop("moved")
        if not now or (now == running and not moved):
            break
        running = now
    else:
        raise RuntimeError(f"rings still grew after {rounds} rounds")
    cyclic = durable(state.where("jump IS NOT NULL").select("node", "low"))
    cut = follows.join(cyclic, "node", "left").select("node", F.when(c("follows") != F.coalesce("low", F.struct(F.lit(-1).cast("long").alias("id"), F.lit(False).alias("back"))), c("follows")).alias("jump"))
    left = durable(cut.select("node", "jump", c("node").alias("end"), F.when(c("jump").isNull(), 0).otherwise(1).cast("long").alias("after")))
    for _ in range(rounds):
        if left.where("jump IS NOT NULL").isEmpty():
            break
        far = left.select(c("node").alias("jump"), c("jump").alias("then"), c("end").alias("stop"), c("after").alias("more"))
        left = durable(left.join(far, "jump", "left").select("node", c("then").alias("jump"), F.coalesce("stop", "end").alias("end"), (c("after") + F.coalesce("more", F.lit(0))).alias("after")))
    else:
        raise RuntimeError(f"chains still grew after {rounds} rounds")
    # the two directions of a chain end in different nodes: keep one of them
    named = left.join(good, left["node"]["id"] == good["id"]).select(c("node.id").alias("id"), c("node.back").alias("back"), "end", "after", F.when(c("node.back"), F.reverse("line")).otherwise(c("line")).alias("line"))
    chains = named.groupBy("end").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-c("after")).alias("place"), "line"))).alias("parts"), F.min(F.struct("id", "back")).alias("least"))
    joined = F.concat(F.get("parts", F.lit(0))["line"], F.flatten(F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: F.slice(p["line"], 2, F.size(p["line"]) - 1))))
    whole = chains.select("first", "n", "least", joined.alias("line"))
    a, b = F.get("line", F.lit(0)), F.element_at("line", -1)
    forward = F.when(a == b, ~c("least.back")).otherwise(a < b)
    return whole.where(forward).select("first", "n", "line").groupBy("first", "n").agg(F.min("line").alias("line"))


def offset_line(line: Column, distance: Column) -> Column:
    """The line moved to its left by `distance` (to the right where it is negative), corners mitred; points that repeat should be taken out before."""
    normals = Y.pairs(line, lambda a, b: F.struct(((a["y"] - b["y"]) / F.hypot(b["x"] - a["x"], b["y"] - a["y"])).alias("x"), ((b["x"] - a["x"]) / F.hypot(b["x"] - a["x"], b["y"] - a["y"])).alias("y")))
    return _once(normals, lambda normals: _mitred(line, distance, normals))


def _once(value: Column, f) -> Column:
    """f(value), with the value worked out once: columns put into one another are copied wherever they are named, a lambda's argument is not."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _mitred(line: Column, distance: Column, normals: Column) -> Column:
    both = F.zip_with(F.concat(F.slice(normals, 1, 1), normals), F.concat(normals, F.slice(normals, -1, 1)), lambda m, n: F.struct(((m["x"] + n["x"]) / (1 + m["x"] * n["x"] + m["y"] * n["y"])).alias("x"), ((m["y"] + n["y"]) / (1 + m["x"] * n["x"] + m["y"] * n["y"])).alias("y")))
    return F.zip_with(line, both, lambda p, m: Y.point(p["x"] + distance * m["x"], p["y"] + distance * m["y"]))


def split_line(line: Column, x: Column, y: Column) -> Column:
    """The two parts of a line cut at its point nearest to a place, as an array of lines; where that is an end, the line alone."""
    def near(a, b, k):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        px, py = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(F.hypot(x - px, y - py).alias("d"), k.alias("k"), Y.point(px, py).alias("p"))

    n = F.size(line)
    places = F.transform(F.sequence(F.lit(0), n - 2), lambda k: near(F.get(line, k), F.get(line, k + 1), k))
    return _once(F.array_min(places), lambda best: _parted(line, best, n))


def _parted(line: Column, best: Column, n: Column) -> Column:
    head = F.concat(F.slice(line, 1, best["k"] + 1), F.array(best["p"]))
    tail = F.concat(F.array(best["p"]), F.slice(line, best["k"] + 2, n - best["k"] - 1))
    clean = lambda part: _once(part, Y.without_repeats)
    whole = (best["p"] == F.get(line, F.lit(0))) | (best["p"] == F.element_at(line, -1))
    return F.when(whole, F.array(line)).otherwise(F.array(clean(head), clean(tail)))


def without_small_bends(line: Column, least: float) -> Column:
    """Inner points whose triangle with the last point kept and the next one has an area under `least` go, from the first on; the ends stay."""
    n = F.size(line)
    inner = F.transform(F.slice(line, 2, F.greatest(n - 2, F.lit(0))), lambda p, k: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.get(line, k + 2).alias("q")))

    def step(kept, p):
        o = F.element_at(kept, -1)
        wide = F.abs((p["x"] - o["x"]) * (p["q"]["y"] - o["y"]) - (p["q"]["x"] - o["x"]) * (p["y"] - o["y"])) / 2 >= least
        return F.when(wide, F.concat(kept, F.array(Y.point(p["x"], p["y"])))).otherwise(kept)

    return F.concat(F.aggregate(inner, F.slice(line, 1, 1), step), F.slice(line, -1, 1))
