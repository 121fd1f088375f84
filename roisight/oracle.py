"""DuckDB SQL for the registered queries, built from shared table expressions."""

from __future__ import annotations

from roisight.functions import half_directions
from roisight.functions.mesh import cube_triangles, square_segments
from roisight.queries import BINS, FEW_BINS_WIDTH, SLICES, WIDTH

K = "image_id, label, plane, slice_idx"
_EMBEDDED = """vox AS (
  SELECT vec_id // 8 AS image_id, CAST(k % 8 + 1 AS INTEGER) AS x, CAST(k // 8 + 1 AS INTEGER) AS y, CAST(vec_id % 8 + 1 AS INTEGER) AS z,
         CAST(e AS DOUBLE) AS v, CASE WHEN e > 0 THEN 1 ELSE 2 END AS label
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
), img AS (SELECT DISTINCT vec_id // 8 AS image_id, 8 AS nx, 8 AS ny, 8 AS nz, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 1.0::DOUBLE AS s3 FROM embeddings)"""
_LINES_SOURCE = """vox AS (
  SELECT l_suppkey AS image_id, CAST(l_partkey % 32 + 1 AS INTEGER) AS x, CAST(l_orderkey % 32 + 1 AS INTEGER) AS y, l_linenumber AS z, avg(l_quantity) AS v, 1 AS label
  FROM lineitem GROUP BY ALL
), img AS (SELECT DISTINCT l_suppkey AS image_id, 32 AS nx, 32 AS ny, 7 AS nz, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 2.5::DOUBLE AS s3 FROM lineitem)"""
_WHOLE = """roi AS (SELECT image_id, label, 0 AS plane, 0 AS slice_idx, x, y, z, v FROM vox WHERE label IN ({labels})),
sp AS (SELECT image_id, 0 AS plane, s1 AS sx, s2 AS sy, s3 AS sz FROM img)"""
_SLICED = f"""roi AS (
  SELECT image_id, label, p AS plane, i AS slice_idx, CASE p WHEN 1 THEN y ELSE x END AS x, CASE p WHEN 3 THEN y ELSE z END AS y, 1 AS z, v
  FROM vox JOIN (VALUES {", ".join(str(s) for s in SLICES)}) AS w(p, i) ON CASE p WHEN 1 THEN x WHEN 2 THEN y ELSE z END = i WHERE label IN (1, 2)
), sp AS (
  SELECT image_id, p AS plane, CASE p WHEN 1 THEN s2 ELSE s1 END AS sx, CASE p WHEN 3 THEN s2 ELSE s3 END AS sy, CASE p WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS sz
  FROM img, (VALUES (1), (2), (3)) AS w(p)
)"""


def _levels(bins: int | None = None, width: float | None = None) -> str:
    if bins:
        scale, level = f"1.0 / CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / {float(bins)} END", f"least(floor((v - lo) * scale) + 1, {bins})"
    else:
        scale, level = f"1.0 / {width or 25.0}", "floor(v * scale) - floor(lo * scale) + 1"
    return f"""lev AS (
  SELECT * EXCLUDE (lo, hi, scale), CAST({level} AS INTEGER) AS g
  FROM (SELECT roi.*, lo, hi, CAST({scale} AS DOUBLE) AS scale FROM roi JOIN (SELECT {K}, min(v) AS lo, max(v) AS hi FROM roi GROUP BY ALL) USING ({K}))
)"""


def _lines(ndim: int) -> str:
    steps = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(half_directions(ndim)))
    return f"""lin AS (
  SELECT *, CASE WHEN lag(t) OVER w = t - 1 THEN lag(g) OVER w END AS pg, CASE WHEN lead(t) OVER w = t + 1 THEN lead(g) OVER w END AS ng
  FROM (SELECT {K}, dir, x - t * dx AS lx, y - t * dy AS ly, z - t * dz AS lz, t, x, y, z, g
        FROM (SELECT *, CASE WHEN dx <> 0 THEN x WHEN dy <> 0 THEN y ELSE z END AS t FROM lev, (VALUES {steps}) AS s(dir, dx, dy, dz)))
  WINDOW w AS (PARTITION BY {K}, dir, lx, ly, lz ORDER BY t)
)"""


def _near(a: int = 0) -> str:
    return f"""near AS (
  SELECT {K}, x, y, z, g, CAST(sum(CASE WHEN abs(pg - g) <= {a} THEN 1 ELSE 0 END + CASE WHEN abs(ng - g) <= {a} THEN 1 ELSE 0 END) + 1 AS BIGINT) AS dep,
         sum(coalesce(pg, 0) + coalesce(ng, 0)) AS near_sum, count(pg) + count(ng) AS near_n FROM lin GROUP BY ALL
)"""


_PAIRS = f"cnt AS (SELECT {K}, dir, i, j, count(*) AS n FROM (SELECT {K}, dir, g AS i, pg AS j FROM lin WHERE pg IS NOT NULL UNION ALL SELECT {K}, dir, pg, g FROM lin WHERE pg IS NOT NULL) GROUP BY ALL)"
_RUNS = f"""rc AS (
  SELECT {K}, dir, g, len, count(*) AS n FROM (
    SELECT {K}, dir, lx, ly, lz, g, t - rn AS run, count(*) AS len
    FROM (SELECT *, row_number() OVER (PARTITION BY {K}, dir, lx, ly, lz, g ORDER BY t) AS rn FROM lin) GROUP BY ALL
  ) GROUP BY ALL
)"""


def _length(norm: str, ndim: int) -> str:
    parts = [f"abs(dx) * sx", f"abs(dy) * sy", f"abs(dz) * sz"][:ndim]
    return {"infinity": f"greatest({', '.join(parts)})", "euclidean": f"sqrt({' + '.join(f'pow({p}, 2)' for p in parts)})", "manhattan": " + ".join(parts)}[norm]


def _weights(norm: str, ndim: int, power: str) -> str:
    steps = ", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(half_directions(ndim)))
    return f"wt AS (SELECT image_id, plane, dir, {power.format(f'({_length(norm, ndim)})')} AS w FROM sp, (VALUES {steps}) AS s(dir, dx, dy, dz))"


_GLCM_PLAIN = f"gm AS (SELECT {K}, dir, i, j, n / sum(n) OVER (PARTITION BY {K}, dir) AS p FROM cnt)"
_GLCM_WEIGHTED = f"gm AS (SELECT {K}, -1 AS dir, i, j, n / sum(n) OVER (PARTITION BY {K}) AS p FROM (SELECT {K}, i, j, sum(n * w) AS n FROM cnt JOIN wt USING (image_id, plane, dir) GROUP BY ALL))"
_E = "2.2e-16"
_GLCM_FEATURES = f"""span AS (SELECT {K}, CAST(max(g) - min(g) + 1 AS DOUBLE) AS span FROM lev GROUP BY ALL),
px AS (SELECT {K}, dir, i, sum(p) AS px FROM gm GROUP BY ALL), ps AS (SELECT {K}, dir, i + j AS k, sum(p) AS ps FROM gm GROUP BY ALL),
pd AS (SELECT {K}, dir, abs(i - j) AS d, sum(p) AS pd FROM gm GROUP BY ALL),
mu AS (SELECT {K}, dir, sum(i * px) AS mu FROM px GROUP BY ALL),
mo AS (SELECT {K}, dir, sum(pow(i - mu, 2) * px) AS var, -sum(px * log2(px + {_E})) AS hx FROM px JOIN mu USING ({K}, dir) GROUP BY ALL),
sums AS (SELECT {K}, dir, sum(k * ps) AS sa, -sum(ps * log2(ps + {_E})) AS se FROM ps GROUP BY ALL),
difs AS (SELECT {K}, dir, -sum(pd * log2(pd + {_E})) AS de FROM pd GROUP BY ALL),
m AS (
  SELECT {K}, dir, sum(i * j * p) AS ac, sum(pow(i + j - 2 * mu, 4) * p) AS cp, sum(pow(i + j - 2 * mu, 3) * p) AS cs, sum(pow(i + j - 2 * mu, 2) * p) AS ct, sum(pow(i - j, 2) * p) AS con,
         sum((i - mu) * (j - mu) * p) AS cov, sum(p * p) AS je, -sum(p * log2(p + {_E})) AS jent, sum(p / (1 + pow(i - j, 2))) AS idm, sum(p / (1 + pow((i - j) / span, 2))) AS idmn,
         sum(p / (1 + abs(i - j))) AS id, sum(p / (1 + abs(i - j) / span)) AS idn, coalesce(sum(p / pow(i - j, 2)) FILTER (WHERE i <> j), 0) AS inv, max(p) AS mp, sum(abs(i - j) * p) AS da,
         -sum(p * log2(a.px * b.px + {_E})) AS h1, max(mu) AS mu
  FROM gm JOIN mu USING ({K}, dir) JOIN span USING ({K}) JOIN px AS a USING ({K}, dir, i) JOIN (SELECT {K}, dir, i AS j, px FROM px) AS b USING ({K}, dir, j) GROUP BY ALL
), f AS (
  SELECT {K}, ac AS "Autocorrelation", cp AS "ClusterProminence", cs AS "ClusterShade", ct AS "ClusterTendency", con AS "Contrast", CASE WHEN var = 0 THEN 0 ELSE cov / var END AS "Correlation",
         je AS "JointEnergy", jent AS "JointEntropy", idm AS "Idm", idmn AS "Idmn", id AS "Id", idn AS "Idn", inv AS "InverseVariance", mp AS "MaximumProbability", da AS "DifferenceAverage",
         de AS "DifferenceEntropy", con - da * da AS "DifferenceVariance", sa AS "SumAverage", se AS "SumEntropy", var AS "SumSquares", mu AS "JointAverage",
         CASE WHEN hx > 0 THEN (jent - h1) / hx ELSE 0 END AS "Imc1", CASE WHEN 2 * hx > jent THEN sqrt(1 - exp(-2 * (2 * hx - jent))) ELSE 0 END AS "Imc2"
  FROM m JOIN mo USING ({K}, dir) JOIN sums USING ({K}, dir) JOIN difs USING ({K}, dir)
), out AS (SELECT {K}, avg(COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx))) FROM f GROUP BY {K})"""


def _emphasis(source: str, size: str, group: str, eps: str, names: dict[str, str], average: bool) -> str:
    """Shared measures of (level, size) matrices."""
    log = f"log2(n / nr + {eps})" if eps else "log2(n / nr)"
    measures = {
        "small": f"sum(n / pow({size}, 2)) / nr", "large": f"sum(n * pow({size}, 2)) / nr", "gln": "max(gg) / nr", "glnn": "max(gg) / nr / nr", "sn": "max(ss) / nr", "snn": "max(ss) / nr / nr",
        "share": f"nr / sum(n * {size})", "glv": "sum(n * pow(g - mi, 2)) / nr", "sv": f"sum(n * pow({size} - mj, 2)) / nr", "entropy": f"-sum(n / nr * {log})", "low": "sum(n / pow(g, 2)) / nr",
        "high": "sum(n * pow(g, 2)) / nr", "small_low": f"sum(n / pow(g * {size}, 2)) / nr", "small_high": f"sum(n * pow(g, 2) / pow({size}, 2)) / nr",
        "large_low": f"sum(n * pow({size}, 2) / pow(g, 2)) / nr", "large_high": f"sum(n * pow(g * {size}, 2)) / nr",
    }
    chosen = ", ".join(f'{measures[k]} AS "{v}"' for k, v in names.items())
    out = f", out AS (SELECT {K}, avg(COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx))) FROM f0 GROUP BY {K})" if average else ", out AS (SELECT * FROM f0)"
    return f"""src AS (SELECT {group}, CAST(g AS DOUBLE) AS g, CAST({size} AS DOUBLE) AS {size}, CAST(n AS DOUBLE) AS n FROM {source}),
tot AS (SELECT {group}, sum(n) AS nr, sum(n * g) / sum(n) AS mi, sum(n * {size}) / sum(n) AS mj FROM src GROUP BY ALL),
gl AS (SELECT {group}, sum(n * n) AS gg FROM (SELECT {group}, g, sum(n) AS n FROM src GROUP BY ALL) GROUP BY ALL),
sl AS (SELECT {group}, sum(n * n) AS ss FROM (SELECT {group}, {size}, sum(n) AS n FROM src GROUP BY ALL) GROUP BY ALL),
f0 AS (SELECT {K}, {chosen} FROM src JOIN tot USING ({group}) JOIN gl USING ({group}) JOIN sl USING ({group}) GROUP BY {group}, nr){out}"""


_RUN_KEYS = ("small", "large", "gln", "glnn", "sn", "snn", "share", "glv", "sv", "entropy", "low", "high", "small_low", "small_high", "large_low", "large_high")
_DEP_KEYS = tuple(k for k in _RUN_KEYS if k not in ("glnn", "share"))


def _glrlm(merge: str | None) -> str:
    from roisight.operators.zones import RUN_NAMES

    source = "rc"
    pre = ""
    if merge:
        weighted = "sum(2 * n)" if merge == "no_weighting" else "sum(2 * n * w)"
        join = "" if merge == "no_weighting" else " JOIN wt USING (image_id, plane, dir)"
        pre, source = f"rw AS (SELECT {K}, -1 AS dir, g, len, {weighted} AS n FROM rc{join} GROUP BY ALL), ", "rw"
    return pre + _emphasis(source, "len", f"{K}, dir", "1e-16", dict(zip(_RUN_KEYS, RUN_NAMES, strict=True)), True)


def _zones() -> str:
    from roisight.operators.zones import ZONE_NAMES

    return _emphasis("zm", "size", K, "1e-16", dict(zip(_RUN_KEYS, ZONE_NAMES, strict=True)), False)


def _dependences() -> str:
    from roisight.operators.zones import DEPENDENCE_NAMES

    order = ("small", "large", "gln", "sn", "snn", "glv", "sv", "entropy", "low", "high", "small_low", "small_high", "large_low", "large_high")
    return _emphasis("dm", "dep", K, "", dict(zip(order, DEPENDENCE_NAMES, strict=True)), False)


def _components(table: str, level: str) -> str:
    """Each voxel's first voxel (x fastest) by transitive closure of neighbours; ``code`` orders voxels."""
    return f"""nod AS (SELECT {K}, {level} AS g, x, y, z, z * 10000 + y * 100 + x AS code FROM {table}),
adj AS (SELECT {", ".join(f"a.{k.strip()}" for k in K.split(","))}, a.code AS a, b.code AS b FROM nod AS a JOIN nod AS b USING ({K}, g)
        WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
rea AS (SELECT {K}, code AS a, code AS b FROM nod UNION SELECT adj.image_id, adj.label, adj.plane, adj.slice_idx, rea.a, adj.b FROM rea JOIN adj
        ON rea.b = adj.a AND rea.image_id = adj.image_id AND rea.label = adj.label AND rea.plane = adj.plane AND rea.slice_idx = adj.slice_idx),
com AS (SELECT nod.*, first FROM nod JOIN (SELECT {K}, a AS code, min(b) AS first FROM rea GROUP BY ALL) USING ({K}, code))"""


_ZM = f"zm AS (SELECT {K}, g, size, count(*) AS n FROM (SELECT {K}, g, first, count(*) AS size FROM com GROUP BY ALL) GROUP BY ALL)"
_DM = f"dm AS (SELECT {K}, g, dep, count(*) AS n FROM near GROUP BY ALL)"
_NM = f"nm AS (SELECT {K}, g, count(*) AS n, sum(abs(g - near_sum / near_n)) AS s FROM near WHERE near_n > 0 GROUP BY ALL)"
_NGTDM = f"""lv AS (SELECT *, n / sum(n) OVER w AS p, sum(n) OVER w AS nv, count(*) OVER w AS ngp, sum(s) OVER w AS ss FROM nm WINDOW w AS (PARTITION BY {K})),
one AS (SELECT {K}, sum(p * s) AS ps, max(nv) AS nv, max(ngp) AS ngp, max(ss) AS ss FROM lv GROUP BY ALL),
two AS (SELECT {K}, sum(a.p * b.p * pow(a.g - b.g, 2)) AS sp, sum(abs(a.g * a.p - b.g * b.p)) AS bu, sum(abs(a.g - b.g) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS co,
               sum((a.p + b.p) * pow(a.g - b.g, 2)) AS st FROM lv AS a JOIN lv AS b USING ({K}) GROUP BY {K}),
out AS (SELECT {K}, CASE WHEN ps = 0 THEN 1e6 ELSE 1 / ps END AS "Coarseness", CASE WHEN ngp <= 1 THEN 0 ELSE sp * ss / nv / (ngp * (ngp - 1)) END AS "Contrast",
               CASE WHEN bu = 0 THEN 0 ELSE ps / bu END AS "Busyness", co / nv AS "Complexity", CASE WHEN ss = 0 THEN 0 ELSE st / ss END AS "Strength" FROM one JOIN two USING ({K}))"""


def _rank(share: float) -> str:
    return f"s[CAST(greatest(1, least(n, round_even({share} * n, 0))) AS BIGINT)]"


_QUANTILES = f"""srt AS (SELECT {K}, list_sort(list(v)) AS s, count(*) AS n FROM roi GROUP BY ALL),
qs AS (SELECT {K}, {", ".join(f"{_rank(p / 100)} AS p{p}" for p in (10, 25, 50, 75, 90))} FROM srt)"""
_FIRST = f"""{_QUANTILES},
b AS (SELECT {K}, count(*) AS n, sum(v * v) AS energy, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM roi GROUP BY ALL),
c AS (SELECT {K}, avg(pow(v - mean, 2)) AS m2, avg(pow(v - mean, 3)) AS m3, avg(pow(v - mean, 4)) AS m4, avg(abs(v - mean)) AS mad, avg(v) FILTER (WHERE v BETWEEN p10 AND p90) AS im
      FROM roi JOIN b USING ({K}) JOIN qs USING ({K}) GROUP BY ALL),
r AS (SELECT {K}, avg(abs(v - im)) AS rmad FROM roi JOIN c USING ({K}) JOIN qs USING ({K}) WHERE v BETWEEN p10 AND p90 GROUP BY ALL),
h AS (SELECT {K}, -sum(p * log2(p + 2.2204460492503131e-16)) AS entropy, sum(p * p) AS uniformity FROM (SELECT {K}, count(*) / max(n) AS p FROM lev JOIN b USING ({K}) GROUP BY {K}, g) GROUP BY ALL),
out AS (SELECT {K}, energy, energy * sx * sy * sz AS total_energy, entropy, lo AS minimum, hi AS maximum, hi - lo AS range, mean, p50 AS median, p10 AS percentile10, p90 AS percentile90,
        p75 - p25 AS interquartile_range, mad AS mean_absolute_deviation, coalesce(rmad, 0) AS robust_mean_absolute_deviation, sqrt(energy / n) AS root_mean_squared,
        CASE WHEN m2 = 0 THEN 'nan'::DOUBLE ELSE m3 / pow(m2, 1.5) END AS skewness, CASE WHEN m2 = 0 THEN 'nan'::DOUBLE ELSE m4 / (m2 * m2) END AS kurtosis, m2 AS variance, uniformity,
        CASE WHEN n = 1 THEN 'nan'::DOUBLE ELSE sqrt(m2 * n / (n - 1)) END AS standard_deviation
        FROM b JOIN c USING ({K}) JOIN qs USING ({K}) JOIN h USING ({K}) LEFT JOIN r USING ({K}) JOIN sp USING (image_id, plane))"""


def _cells(ndim: int) -> str:
    corners = ", ".join(f"({b & 1}, {b >> 1 & 1}, {b >> 2 & 1}, {1 << b})" for b in range(2**ndim))
    return f"cel AS (SELECT {K}, x - ox AS cx, y - oy AS cy, z - oz AS cz, CAST(sum(bit) AS INTEGER) AS case_ FROM roi, (VALUES {corners}) AS o(ox, oy, oz, bit) GROUP BY ALL)"


def _pieces(ndim: int) -> str:
    make = cube_triangles if ndim == 3 else square_segments
    rows = ", ".join("(" + ", ".join(str(n) for n in (case, *(c for p in piece for c in p))) + ")" for case in range(2 ** (2**ndim)) for piece in make(case))
    names = [f"{p}{c}" for p in "pqr"[:ndim] for c in "xyz"]
    moved = ", ".join(f"(2 * c{c} + t.{p}{c}) * s{c} / 2 AS {p}{c}" for p in "pqr"[:ndim] for c in "xyz")
    return f"pie AS (SELECT {K}, {moved} FROM cel JOIN (VALUES {rows}) AS t(case_, {', '.join(names)}) USING (case_) JOIN sp USING (image_id, plane))"


_MESH2 = f"out AS (SELECT {K}, sum(sqrt(pow(px - qx, 2) + pow(py - qy, 2))) AS perimeter, abs(sum(px * qy - py * qx) / 2) AS mesh_surface FROM pie GROUP BY ALL)"
_MESH3 = f"""out AS (SELECT {K}, sum(sqrt(pow(uy * wz - uz * wy, 2) + pow(uz * wx - ux * wz, 2) + pow(ux * wy - uy * wx, 2)) / 2) AS surface_area,
  abs(sum(px * (qy * rz - qz * ry) + py * (qz * rx - qx * rz) + pz * (qx * ry - qy * rx)) / 6) AS mesh_volume
  FROM (SELECT *, qx - px AS ux, qy - py AS uy, qz - pz AS uz, rx - px AS wx, ry - py AS wy, rz - pz AS wz FROM pie) GROUP BY {K})"""


def _diameter(ndim: int, name: str) -> str:
    union = " UNION ".join(f"SELECT {K}, {p}x AS x, {p}y AS y, {p}z AS z FROM pie" for p in "pqr"[:ndim])
    square = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in "xyz"[:ndim])
    return f"pts AS ({union}), out AS (SELECT {K}, sqrt(max({square})) AS {name} FROM pts AS a JOIN pts AS b USING ({K}) GROUP BY {K})"


_AXES2 = f"""cv AS (SELECT {K}, avg(px * px) - pow(avg(px), 2) AS a, avg(py * py) - pow(avg(py), 2) AS b, avg(px * py) - avg(px) * avg(py) AS c
  FROM (SELECT {K}, (x - 1) * sx AS px, (y - 1) * sy AS py FROM roi JOIN sp USING (image_id, plane)) GROUP BY ALL),
ev AS (SELECT {K}, CASE WHEN abs(l) <= 1e-12 * h THEN 0 ELSE l END AS l, h FROM (SELECT *, (a + b - sqrt(pow(a - b, 2) + 4 * c * c)) / 2 AS l, (a + b + sqrt(pow(a - b, 2) + 4 * c * c)) / 2 AS h FROM cv)),
out AS (SELECT {K}, 4 * sqrt(h) AS major_axis_length, CASE WHEN l < 0 THEN 'nan'::DOUBLE ELSE 4 * sqrt(l) END AS minor_axis_length, CASE WHEN h = 0 THEN 'nan'::DOUBLE ELSE sqrt(greatest(l, 0) / h) END AS elongation FROM ev)"""


_AXES3 = f"""cv AS (SELECT {K}, count(*) AS n, coalesce(covar_samp(px, px), 0) AS a, coalesce(covar_samp(py, py), 0) AS b, coalesce(covar_samp(pz, pz), 0) AS c,
  coalesce(covar_samp(px, py), 0) AS d, coalesce(covar_samp(px, pz), 0) AS e, coalesce(covar_samp(py, pz), 0) AS f
  FROM (SELECT {K}, (x - 0.5) * sx AS px, (y - 0.5) * sy AS py, (z - 0.5) * sz AS pz FROM roi JOIN sp USING (image_id, plane)) GROUP BY ALL),
e1 AS (SELECT *, (a + b + c) / 3 AS q FROM cv),
e2 AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM e1),
e3 AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE least(1, greatest(-1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / pow(p, 3) / 2)) END AS r FROM e2),
e4 AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS h, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM e3),
ev AS (SELECT {K}, n, h, CASE WHEN l > 1e-12 * h THEN l ELSE 0 END AS l1, CASE WHEN 3 * q - h - l > 1e-12 * h THEN 3 * q - h - l ELSE 0 END AS l2 FROM e4),
out AS (SELECT {K}, 4 * sqrt(l1) AS least_axis_length, 4 * sqrt(l2) AS minor_axis_length, 4 * sqrt(h) AS major_axis_length,
  CASE WHEN n > 1 AND l2 > 0 THEN sqrt(l2 / h) ELSE 'nan'::DOUBLE END AS elongation, CASE WHEN n > 1 AND l1 > 0 THEN sqrt(l1 / h) ELSE 'nan'::DOUBLE END AS flatness FROM ev)"""


def _named(part: str, name: str) -> str:
    """A part whose result is called otherwise than out."""
    head, _, tail = part.rpartition("out AS (")
    return f"{head}{name} AS ({tail}"


_SHAPE2 = f"""isl AS (SELECT {K}, count(DISTINCT first) AS number_of_islands FROM com GROUP BY ALL),
out AS (SELECT {K}, perimeter, mesh_surface, maximum_diameter, n * sx * sy AS pixel_surface, perimeter / mesh_surface AS perimeter_surface_ratio, 2 * sqrt(pi() * mesh_surface) / perimeter AS sphericity,
  major_axis_length, minor_axis_length, elongation
  FROM mesh JOIN dia USING ({K}) JOIN axes USING ({K}) JOIN (SELECT {K}, count(*) AS n FROM roi GROUP BY ALL) USING ({K}) JOIN sp USING (image_id, plane))"""
_SHAPE3 = f"""out AS (SELECT {K}, surface_area, mesh_volume, surface_area / mesh_volume AS surface_volume_ratio, pow(pi(), 1 / 3) * pow(6 * mesh_volume, 2 / 3) / surface_area AS sphericity, maximum_3d_diameter,
  least_axis_length, minor_axis_length, major_axis_length, elongation, flatness, n * sx * sy * sz AS voxel_volume
  FROM mesh JOIN dia USING ({K}) JOIN axes USING ({K}) JOIN (SELECT {K}, count(*) AS n FROM roi GROUP BY ALL) USING ({K}) JOIN sp USING (image_id, plane))"""


def _sql(*parts: str, select: str = "rounded", recursive: bool = False) -> str:
    chosen = f"SELECT {K}, round(COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx)) + 1e-9, 6) FROM out" if select == "rounded" else select
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {chosen}"


def oracle_sql() -> dict[str, str]:
    whole, one = _WHOLE.format(labels="1, 2"), _WHOLE.format(labels="1")
    volumes, flat, sparse = (_EMBEDDED, whole), (_EMBEDDED, _SLICED), (_LINES_SOURCE, one)
    bins, l3, l2 = _levels(BINS), _lines(3), _lines(2)
    level_counts = f"SELECT {K}, g, count(*) AS voxels FROM lev GROUP BY ALL"
    first_of = f"SELECT {K}, x, y, z, CAST(first % 100 AS INTEGER) AS first_x, CAST(first // 100 % 100 AS INTEGER) AS first_y, CAST(first // 10000 AS INTEGER) AS first_z FROM com"
    biggest = f"SELECT {K}, x, y, z FROM com JOIN (SELECT {K}, first FROM (SELECT {K}, first, row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, first) AS r FROM com GROUP BY {K}, first) WHERE r = 1) USING ({K}, first)"
    zoned = f"SELECT {K}, g, size, n FROM zm"
    found = {
        "label_filter": _sql(_EMBEDDED, one, select=f"SELECT {K}, count(*) AS voxels FROM roi GROUP BY ALL"),
        "multi_label": _sql(*volumes, select=f"SELECT {K}, count(*) AS voxels FROM roi GROUP BY ALL"),
        "missing_labels": _sql(_EMBEDDED, select="SELECT image_id, l AS label FROM img, (VALUES (1), (2), (3)) AS w(l) WHERE NOT EXISTS (SELECT 1 FROM vox WHERE vox.image_id = img.image_id AND vox.label = l)"),
        "slice_2d": _sql(*flat, select="SELECT image_id, label, plane, slice_idx, x, y, z, round(v + 1e-9, 6) AS v FROM roi"),
        "slice_spacing": _sql(_LINES_SOURCE, _SLICED, select="SELECT image_id, plane, sx, sy, sz FROM sp"),
        "bounding_box": _sql(*sparse, select=f"SELECT {K}, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM roi GROUP BY ALL"),
        "crop": _sql(*sparse, select=f"SELECT {K}, x - min(x) OVER w + 2 AS x, y - min(y) OVER w + 2 AS y, z - min(z) OVER w + 2 AS z, round(v + 1e-9, 6) AS v FROM roi WINDOW w AS (PARTITION BY {K})"),
        "discretize_n_bins": _sql(*volumes, bins, select=level_counts),
        "discretize_bin_width": _sql(*volumes, _levels(width=WIDTH), select=level_counts),
        "discretize_default": _sql(*sparse, _levels(), select=level_counts),
        "binning_warning": _sql(*volumes, select=f"SELECT {K}, round(max(v) - min(v) + 1e-9, 6) AS span, CAST(ceil((max(v) - min(v)) / {FEW_BINS_WIDTH}) AS BIGINT) AS bins FROM roi GROUP BY ALL HAVING ceil((max(v) - min(v)) / {FEW_BINS_WIDTH}) < 3"),
        "first_order": _sql(*volumes, bins, _FIRST),
        "first_order_bin_width": _sql(*volumes, _levels(width=WIDTH), _FIRST),
        "first_order_slices": _sql(*flat, bins, _FIRST),
        "first_order_sparse": _sql(*sparse, _levels(), _FIRST),
        "first_order_quantiles": _sql(*volumes, _QUANTILES, "out AS (SELECT * FROM qs)"),
        "along_lines": _sql(*volumes, bins, l3, select=f"SELECT {K}, dir, count(*) AS voxels, count(pg) AS pairs, CAST(sum(coalesce(ng, 0)) AS BIGINT) AS next_sum FROM lin GROUP BY ALL"),
        "glcm_counts": _sql(*volumes, bins, l3, _PAIRS, select=f"SELECT {K}, dir, i, j, n FROM cnt"),
        "glcm_matrix": _sql(*volumes, bins, l3, _PAIRS, _GLCM_PLAIN, select=f"SELECT {K}, dir, i, j, round(p + 1e-9, 6) AS p FROM gm"),
        "glcm_features": _sql(*volumes, bins, l3, _PAIRS, _GLCM_PLAIN, _GLCM_FEATURES),
        "glcm_slices": _sql(*flat, bins, l2, _PAIRS, _GLCM_PLAIN, _GLCM_FEATURES),
        "glcm_sparse": _sql(*sparse, bins, l3, _PAIRS, _GLCM_PLAIN, _GLCM_FEATURES),
        "glrlm_matrix": _sql(*volumes, bins, l3, _RUNS, select=f"SELECT {K}, dir, g, len, CAST(n AS DOUBLE) AS n FROM rc"),
        "glrlm_features": _sql(*volumes, bins, l3, _RUNS, _glrlm(None)),
        "glrlm_slices": _sql(*flat, bins, l2, _RUNS, _glrlm(None)),
        "glrlm_no_weighting": _sql(*volumes, bins, l3, _RUNS, _glrlm("no_weighting")),
        "connected_components": _sql(*flat, _components("roi", "0"), select=first_of, recursive=True),
        "level_components": _sql(*flat, bins, _components("lev", "g"), select=first_of, recursive=True),
        "spread_components": _sql(*flat, bins, _components("lev", "g"), _ZM, select=zoned, recursive=True),
        "island_counts": _sql(*flat, _components("roi", "0"), select=f"SELECT {K}, CAST(count(DISTINCT first) AS INTEGER) AS islands FROM com GROUP BY ALL", recursive=True),
        "largest_component": _sql(*flat, _components("roi", "0"), select=biggest, recursive=True),
        "glszm_matrix": _sql(*flat, bins, _components("lev", "g"), _ZM, select=zoned, recursive=True),
        "glszm_features": _sql(*flat, bins, _components("lev", "g"), _ZM, _zones(), recursive=True),
        "glszm_volumes": _sql(*volumes, bins, _components("lev", "g"), _ZM, _zones(), recursive=True),
        "gldm_matrix": _sql(*volumes, bins, l3, _near(), _DM, select=f"SELECT {K}, g, dep, n FROM dm"),
        "gldm_features": _sql(*volumes, bins, l3, _near(), _DM, _dependences()),
        "gldm_near_levels": _sql(*volumes, bins, l3, _near(1), _DM, _dependences()),
        "ngtdm_matrix": _sql(*volumes, bins, l3, _near(), _NM, select=f"SELECT {K}, g, n, round(s + 1e-9, 6) AS s FROM nm"),
        "ngtdm_features": _sql(*volumes, bins, l3, _near(), _NM, _NGTDM),
        "ngtdm_sparse": _sql(*sparse, bins, l3, _near(), _NM, _NGTDM),
        "mesh_cells_2d": _sql(*flat, _cells(2), select=f'SELECT {K}, cx, cy, cz, case_ AS "case" FROM cel'),
        "mesh_metrics_2d": _sql(*flat, _cells(2), _pieces(2), _MESH2),
        "diameter_2d": _sql(*flat, _cells(2), _pieces(2), _diameter(2, "maximum_diameter")),
        "principal_axes_2d": _sql(*flat, _AXES2),
        "mesh_cells_3d": _sql(*volumes, _cells(3), select=f'SELECT {K}, cx, cy, cz, case_ AS "case" FROM cel'),
        "mesh_metrics_3d": _sql(*volumes, _cells(3), _pieces(3), _MESH3),
        "diameter_3d": _sql(*volumes, _cells(3), _pieces(3), _diameter(3, "maximum_3d_diameter")),
    }
    shown = f"SELECT {K}, round(COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx)) + 1e-9, 6), CAST({{}} AS INTEGER) AS number_of_islands FROM out"
    found["principal_axes_3d"] = _sql(*volumes, _AXES3)
    found["shape2d"] = _sql(
        *flat, _cells(2), _pieces(2), _named(_MESH2, "mesh"), _named(_diameter(2, "maximum_diameter"), "dia"), _named(_AXES2, "axes"), _components("roi", "0"), _SHAPE2,
        select=f"SELECT * FROM ({shown.format(0)}) AS o".replace("SELECT *", "SELECT o.* EXCLUDE (number_of_islands), CAST(isl.number_of_islands AS INTEGER) AS number_of_islands") + f" JOIN isl USING ({K})", recursive=True,
    )
    found["shape3d"] = _sql(*volumes, _cells(3), _pieces(3), _named(_MESH3, "mesh"), _named(_diameter(3, "maximum_3d_diameter"), "dia"), _named(_AXES3, "axes"), _SHAPE3, select=shown.format(1))
    first, tone = _named(_FIRST, "fo"), _named(_NGTDM, "ng")
    long = "SELECT {K}, '{f}' AS family, '{p}_' || feature AS feature, round(value + 1e-9, 6) AS value FROM (UNPIVOT {t} ON COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx)) INTO NAME feature VALUE value)"
    tables = (*volumes, bins, l3, _near(), _NM, tone.replace("one AS", "o1 AS").replace("FROM one", "FROM o1"), first)
    found["features_long"] = _sql(*tables, select=long.format(K=K, f="first_order", p="firstorder", t="fo") + " UNION ALL " + long.format(K=K, f="ngtdm", p="ngtdm", t="ng"))
    prefixed = "round(COLUMNS({t}.* EXCLUDE (image_id, label, plane, slice_idx)) + 1e-9, 6) AS \"{p}_\\0\""
    found["extract_features"] = _sql(
        *volumes, bins, l3, _near(), _DM, first, _named(_dependences(), "de"),
        select=f"SELECT {K}, {prefixed.format(t='fo', p='firstorder')}, {prefixed.format(t='de', p='gldm')}, label AS label_id FROM fo JOIN de USING ({K})",
    )
    found["features_json"] = _sql(
        _EMBEDDED, one, bins, l3, _near(), _NM, _NGTDM, select=f"""SELECT {K}, '{{"label_id":' || label || ',"ngtdm_Contrast":' || CAST(round(Contrast, 6) AS VARCHAR) || '}}' AS features FROM out""",
    )
    size = lambda f: f"concat_ws('x', {', '.join(f.format(c=c) for c in 'xyz')})"
    found["diagnostics"] = _sql(
        *volumes, select=f"""SELECT {K}, 25.0::DOUBLE AS "diagnosis_Bin_width", {BINS} AS "diagnosis_Number_of_bins", 'no_weighting' AS "diagnosis_Weighting_norm", true AS "diagnosis_Keep_largest_only",
        '3D' AS "diagnosis_Dimensionality_of_image", '1.0x1.0x1.0' AS "diagnosis_Voxel_spacing", {size("any_value(n{c})")} AS "diagnosis_Image_size", {size("max({c}) - min({c}) + 1")} AS "diagnosis_Image_size_cropped",
        {size("any_value(n{c})")} AS "diagnosis_Mask_size", {size("max({c}) - min({c}) + 1")} AS "diagnosis_Mask_size_cropped" FROM roi JOIN img USING (image_id) GROUP BY {K}""",
    )
    main = f"roi AS (SELECT c.image_id, c.label, c.plane, c.slice_idx, c.x, c.y, c.z, r0.v FROM ({biggest}) AS c JOIN r0 USING ({K}, x, y, z))"
    islands = f"isl AS (SELECT {K}, CAST(count(DISTINCT first) AS INTEGER) AS number_of_islands FROM com GROUP BY ALL)"
    found["shape3d_largest"] = _sql(
        _EMBEDDED, whole.replace("roi AS", "r0 AS", 1), _components("r0", "0"), main, islands, _cells(3), _pieces(3), _named(_MESH3, "mesh"), _named(_diameter(3, "maximum_3d_diameter"), "dia"), _named(_AXES3, "axes"), _SHAPE3,
        select=f"SELECT o.*, number_of_islands FROM (SELECT {K}, round(COLUMNS(* EXCLUDE (image_id, label, plane, slice_idx)) + 1e-9, 6) FROM out) AS o JOIN isl USING ({K})", recursive=True,
    )
    for norm in ("infinity", "euclidean", "manhattan"):
        found[f"glcm_{norm}"] = _sql(*sparse, bins, l3, _PAIRS, _weights(norm, 3, "exp(-pow({}, 2))"), _GLCM_WEIGHTED, _GLCM_FEATURES)
        found[f"glrlm_{norm}"] = _sql(*sparse, bins, l3, _RUNS, _weights(norm, 3, "{}"), _glrlm(norm))
    return found
