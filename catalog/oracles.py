"""DuckDB SQL that computes what the registered queries compute, on the same tables.

Vectors are in long form here: one row per (row id, position). Start weights enter as literal
values from the same helper training uses; everything else is computed in SQL.
"""

from __future__ import annotations

import numpy as np

from layerstack.operators.randoms import fixed_mask, keep_threshold
from layerstack.operators.rules import Rules
from layerstack.plans.update import initial_decoder, initial_encoder

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def number(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def matrix_values(w: np.ndarray) -> str:
    rows = ", ".join(
        f"({i}, {j}, {number(w[i, j])})" for i in range(w.shape[0]) for j in range(w.shape[1])
    )
    return f"SELECT * FROM (VALUES {rows}) AS v(i, j, w)"


def vector_values(values: np.ndarray) -> str:
    rows = ", ".join(f"({i}, {number(v)})" for i, v in enumerate(values, 1))
    return f"SELECT * FROM (VALUES {rows}) AS v(i, v)"


def sigmoid(z: str) -> str:
    return f"1e0 / (1e0 + exp(-({z})))"


def rounded(expression: str, digits: int = 6) -> str:
    """Rounded, with negative zero turned into zero."""
    return f"round({expression}, {digits}) + 0e0"


class Sql:
    """A chain of materialised common table expressions."""

    def __init__(self) -> None:
        self._parts: list[str] = []

    def add(self, name: str, body: str) -> str:
        self._parts.append(f"{name} AS MATERIALIZED (\n{body}\n)")
        return name

    def render(self, final: str) -> str:
        return "WITH " + ",\n".join(self._parts) + "\n" + final


def embeddings_raw(sql: Sql) -> str:
    return sql.add(
        "raw",
        "SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS i, "
        "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    )


def lineitem_raw(sql: Sql) -> str:
    sql.add(
        "li",
        "SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_partkey, "
        + ", ".join(LINE_COLUMNS) + " FROM lineitem",
    )
    return sql.add(
        "raw",
        " UNION ALL ".join(
            f"SELECT id, {i} AS i, {c} AS v FROM li" for i, c in enumerate(LINE_COLUMNS, 1)
        ),
    )


# Values up to this size of an embedding count as 0 in its sparse form.
SMALL = 0.25


def sparse_raw(sql: Sql, both_signs: bool) -> str:
    """Embeddings with most values replaced by 0; without `both_signs`, negative ones too."""
    embeddings_raw(sql)
    kept = f"abs(v) > {number(SMALL)}" if both_signs else f"v > {number(SMALL)}"
    return sql.add("thin", f"SELECT id, i, CASE WHEN {kept} THEN v ELSE 0e0 END AS v FROM raw")


def scaled(sql: Sql, raw: str = "raw") -> str:
    sql.add("rng", f"SELECT i, min(v) AS lo, max(v) AS hi FROM {raw} GROUP BY i")
    return sql.add(
        "x1",
        "SELECT id, i, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0e0 END AS v "
        f"FROM {raw} JOIN rng USING (i)",
    )


def source(table: str) -> tuple[Sql, int]:
    """A chain that ends in the scaled table x1(id, i, v), and its width."""
    sql = Sql()
    raw, width = "raw", 64
    if table == "embeddings":
        embeddings_raw(sql)
    elif table.startswith("thin"):
        raw = sparse_raw(sql, table == "thin_signed")
    else:
        lineitem_raw(sql)
        width = 4
    scaled(sql, raw)
    return sql, width


# --- the row hash of the denoising mask ------------------------------------------------------

# Primes of the public 64-bit xxHash and the default seed of Spark's function.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SEED = 42
_WORD = f"{1 << 64}::UHUGEINT"


def _times(x: str, factor: int) -> str:
    return f"(({x})::UHUGEINT * {factor}::UHUGEINT) % {_WORD}"


def _plus(x: str, addend: int) -> str:
    return f"(({x})::UHUGEINT + {addend}::UHUGEINT) % {_WORD}"


def _turn(x: str, bits: int) -> str:
    return f"({_times(x, 1 << bits)} + (({x})::UHUGEINT // {1 << (64 - bits)}::UHUGEINT))"


def _fold(x: str, bits: int) -> str:
    return f"xor(({x})::UHUGEINT, ({x})::UHUGEINT // {1 << bits}::UHUGEINT)"


def hash_step(inner: str, value: str, seed: str, output: str) -> str:
    """Subquery adding `output` = 64-bit hash (unsigned) of one non-negative or wrapped long."""
    q = f"SELECT *, {_times(value, P2)} AS q0 FROM ({inner})"
    q = f"SELECT *, {_times(_turn('q0', 31), P1)} AS q1, {_plus(seed, P5 + 8)} AS q2 FROM ({q})"
    q = f"SELECT *, xor(q1, q2) AS q3 FROM ({q})"
    q = f"SELECT *, {_plus(_times(_turn('q3', 27), P1), P4)} AS q4 FROM ({q})"
    q = f"SELECT *, {_times(_fold('q4', 33), P2)} AS q5 FROM ({q})"
    q = f"SELECT *, {_times(_fold('q5', 29), P3)} AS q6 FROM ({q})"
    q = f"SELECT *, {_fold('q6', 32)} AS {output} FROM ({q})"
    return f"SELECT * EXCLUDE (q0, q1, q2, q3, q4, q5, q6) FROM ({q})"


def hashed_mask(
    sql: Sql, name: str, width: int, layer: int, epoch: int, seed: int, drop: float
) -> str:
    """CTE name(id, i, k): the 0/1 mask of every (row, feature)."""
    q = hash_step("SELECT vec_id AS id, vec_id AS word FROM embeddings", "word", str(SEED), "h")
    q = hash_step(q, "h", str(SEED), "h1")
    q = hash_step(q, str(layer), "h1", "h2")
    q = hash_step(q, str(epoch), "h2", "h3")
    q = hash_step(q, str(seed), "h3", "h4")
    q = f"SELECT id, h4, CAST(unnest(range(1, {width + 1})) AS INTEGER) AS i FROM ({q})"
    q = hash_step(q, "i - 1", "h4", "h5")
    lowest = keep_threshold(drop)
    signed = f"CASE WHEN h5 >= {1 << 63}::UHUGEINT THEN h5::HUGEINT - {1 << 64}::HUGEINT " \
             "ELSE h5::HUGEINT END"
    return sql.add(
        name,
        f"SELECT id, i, CASE WHEN {signed} >= {lowest} THEN 1e0 ELSE 0e0 END AS k FROM ({q})",
    )


# --- one layer -------------------------------------------------------------------------------


_SIGMOID = "(1e0 / (1e0 + exp(-z)))"
_TANH = "(1e0 - 2e0 / (exp(2e0 * z) + 1e0))"
#: Activations and their derivatives in z.
ACTIVATION_SQL = {
    "sigmoid": (_SIGMOID, f"{_SIGMOID} * (1e0 - {_SIGMOID})"),
    "tanh": (_TANH, f"1e0 - {_TANH} * {_TANH}"),
    "relu": ("greatest(z, 0e0)", "CASE WHEN z >= 0 THEN 1e0 ELSE 0e0 END"),
    "lrelu": (
        "CASE WHEN z >= 0 THEN z ELSE 0.01e0 * z END", "CASE WHEN z >= 0 THEN 1e0 ELSE 0.01e0 END",
    ),
    "elu": (
        "CASE WHEN z >= 0 THEN z ELSE 0.05e0 * (exp(z) - 1e0) END",
        "CASE WHEN z >= 0 THEN 1e0 ELSE 0.05e0 * exp(z) END",
    ),
}


class Layer:
    """SQL names of a forward and backward pass over x(id, i, v) with given weight tables."""

    def __init__(
        self, sql: Sql, tag: str, x: str, n: int, w: str, s: str, method: str,
        semantics: str, mask: str | None = None, tied: bool = False, p: float = 0.05,
        beta: float = 1e-10, activation: str = "sigmoid",
    ):
        self.sql, self.tag, self.n = sql, tag, n
        rules = Rules.of(semantics)
        add = self._add
        self.a = add("a", self._masked(x, mask))
        z = f"SELECT a.id, w.j, sum(a.v * w.w) AS z FROM {self.a} a JOIN {w} w USING (i) GROUP BY 1, 2"
        f, slope = ACTIVATION_SQL[activation]
        self.h = add("h", f"SELECT id, j, {f} AS h, {slope} AS d FROM ({z})")
        self.hb = add(
            "hb",
            f"SELECT id, j + 1 AS i, h AS v FROM {self.h} UNION ALL "
            f"SELECT DISTINCT id, 0, 1e0 FROM {self.h}",
        )
        o = f"SELECT b.id, s.j AS g, sum(b.v * s.w) AS o FROM {self.hb} b JOIN {s} s USING (i) GROUP BY 1, 2"
        self.out = add("o", f"SELECT id, g, {sigmoid('o')} AS p FROM ({o})")
        source = self.a if rules.masked_target else x
        if rules.shift_target and not tied:
            t = f"SELECT id, i AS g, v AS t FROM {self.a} WHERE i < {n}"
        else:
            t = f"SELECT id, i - 1 AS g, v AS t FROM {source} WHERE i > 0"
        self.e = add("e", f"SELECT id, g, t, p, p - t AS e FROM {self.out} JOIN ({t}) USING (id, g)")
        q = "greatest(least(p, 1e0 - 1e-14), 1e-14)" if rules.guard else "p"
        self.losses = add(
            "l", f"SELECT id, -sum(t * ln({q}) + (1e0 - t) * ln(1e0 - {q})) AS loss "
            f"FROM {self.e} GROUP BY id",
        )
        self.pj = add("p", f"SELECT j, avg(h) AS p FROM {self.h} GROUP BY j")
        c = "greatest(least(p, 1e0 - 1e-14), 1e-14)" if rules.guard else "p"
        self.kl = add(
            "kl",
            f"SELECT j, p, {p} * ln({p} / c) + (1e0 - {p}) * ln((1e0 - {p}) / (1e0 - c)) AS kl, "
            f"(1e0 - {p}) / (1e0 - c) - {p} / c AS pull FROM (SELECT j, p, {c} AS c FROM {self.pj})",
        )
        self.sparse = method == "sparse"
        self.pull = number(beta**rules.beta_power) if self.sparse else "0e0"
        self.beta = number(beta)
        back = f"SELECT e.id, s.i - 1 AS j, sum(e.e * s.w) AS b FROM {self.e} e JOIN {s} s " \
               "ON e.g = s.j WHERE s.i > 0 GROUP BY 1, 2"
        self.eh = add(
            "eh",
            f"SELECT id, j, (b + {self.pull} * pull) * d AS e "
            f"FROM ({back}) JOIN {self.h} USING (id, j) JOIN {self.kl} USING (j)",
        )
        encoder = f"SELECT a.i, d.j, sum(a.v * d.e) AS g FROM {self.a} a JOIN {self.eh} d " \
                  "USING (id) GROUP BY 1, 2"
        if tied and not rules.encoder_path:
            shared = f"SELECT e.g + 1 AS i, h.j, sum(e.e * h.h) AS g FROM {self.e} e " \
                     f"JOIN {self.h} h USING (id) GROUP BY 1, 2"
            encoder = f"SELECT i, j, sum(g) AS g FROM ({encoder} UNION ALL {shared}) GROUP BY 1, 2"
        self.gw = add("gw", encoder)
        self.gs = add(
            "gs",
            f"SELECT b.i, e.g AS j, sum(b.v * e.e) AS g FROM {self.hb} b JOIN {self.e} e "
            "USING (id) GROUP BY 1, 2",
        )
        penalty = f"{self.beta} * (SELECT sum(kl) FROM {self.kl})" if self.sparse else "0e0"
        self.j = add(
            "j", f"SELECT avg(loss) + {penalty} AS loss, count(*) AS m FROM {self.losses}"
        )

    def _add(self, name: str, body: str) -> str:
        return self.sql.add(f"{self.tag}_{name}", body)

    def _masked(self, x: str, mask: str | None) -> str:
        bias = f"SELECT DISTINCT id, 0 AS i, 1e0 AS v FROM {x}"
        if mask is None:
            return f"SELECT id, i, v FROM {x} UNION ALL {bias}"
        on = "(id, i)" if mask.startswith("hm") else "(i)"
        return f"SELECT id, i, v * k AS v FROM {x} JOIN {mask} USING {on} UNION ALL {bias}"


def descend(
    sql: Sql, tag: str, theta: str, gradient: str, total: str | None, j: str, lmbda: float,
    learning: float, decay: bool,
) -> tuple[str, str]:
    """Names of the next weights and of the running sum of averaged gradients."""
    d = f"SELECT i, j, w, g / m + CASE WHEN i > 0 THEN {number(lmbda)} * w ELSE 0e0 END AS d " \
        f"FROM {theta} JOIN {gradient} USING (i, j), {j}"
    if total is None:
        body = f"SELECT i, j, w, d, d AS acc FROM ({d})"
    else:
        body = f"SELECT i, j, n.w, n.d, n.d + o.acc AS acc FROM ({d}) n JOIN {total} o USING (i, j)"
    acc = sql.add(f"{tag}_acc", body)
    rate = f"(SELECT {number(learning)} / sqrt(sum(acc * acc)) FROM {acc})"
    factor = f"(1e0 - rate * {number(lmbda)} / m)" if decay else "1e0"
    following = sql.add(
        f"{tag}_next",
        f"SELECT i, j, CASE WHEN i > 0 THEN w * {factor} ELSE w END - rate * d AS w "
        f"FROM {acc}, (SELECT {rate} AS rate), {j}",
    )
    return following, acc


def training(
    sql: Sql, n: int, hidden: list[int], method: str, semantics: str, epochs: int,
    learning: float = 0.1, lmbda: float = 1e-10, beta: float = 1e-10, p: float = 0.05,
    seed: int = 0, drop: float = 0.5, tied: bool = False, start=initial_encoder,
) -> tuple[list[tuple[int, int, str]], list[tuple[str, str]], str]:
    """All epochs of all layers: (layer, epoch, loss table), final (W, S), last code table."""
    rules = Rules.of(semantics)
    losses, finals, x = [], [], "x1"
    for layer, k in enumerate(hidden, 1):
        first = start(n, k, rules, seed, layer)
        w = sql.add(f"w{layer}", matrix_values(first))
        s = sql.add(f"s{layer}", matrix_values(initial_decoder(first)))
        total_w = total_s = fixed = None
        if method == "denoising" and rules.fixed_mask:
            fixed = sql.add(f"fm{layer}", f"SELECT i, v AS k FROM ({vector_values(fixed_mask(n))})")
        for epoch in range(epochs):
            mask = fixed
            if method == "denoising" and not rules.fixed_mask:
                mask = hashed_mask(sql, f"hm{layer}_{epoch}", n, layer, epoch, seed, drop)
            tag = f"t{layer}_{epoch}"
            step = Layer(sql, tag, x, n, w, s, method, semantics, mask, tied, p, beta)
            losses.append((layer, epoch, step.j))
            w, total_w = descend(
                sql, f"{tag}w", w, step.gw, total_w, step.j, lmbda, learning, rules.decay
            )
            if tied:
                s = sql.add(
                    f"{tag}s_next",
                    f"SELECT j + 1 AS i, i - 1 AS j, w FROM {w} WHERE i > 0 UNION ALL "
                    f"SELECT DISTINCT 0, i - 1, 0e0 FROM {w} WHERE i > 0",
                )
            else:
                s, total_s = descend(
                    sql, f"{tag}s", s, step.gs, total_s, step.j, lmbda, learning, rules.decay
                )
        finals.append((w, s))
        x = forward(sql, f"c{layer}", x, w, fixed)
        n = k
    return losses, finals, x


def forward(sql: Sql, name: str, x: str, w: str, mask: str | None = None,
            activation: str = "sigmoid") -> str:
    """CTE name(id, i, v): codes of x, positions from 1."""
    inputs = x if mask is None else f"(SELECT id, i, v * k AS v FROM {x} JOIN {mask} USING (i))"
    z = f"SELECT a.id, w.j, sum(a.v * w.w) AS z FROM (SELECT id, i, v FROM {inputs} UNION ALL " \
        f"SELECT DISTINCT id, 0, 1e0 FROM {x}) a JOIN {w} w USING (i) GROUP BY 1, 2"
    f = {
        "sigmoid": sigmoid("z"),
        "tanh": "1e0 - 2e0 / (exp(2e0 * z) + 1e0)",
        "relu": "greatest(z, 0e0)",
        "lrelu": "CASE WHEN z >= 0 THEN z ELSE 0.01e0 * z END",
        "elu": "CASE WHEN z >= 0 THEN z ELSE 0.05e0 * (exp(z) - 1e0) END",
    }[activation]
    return sql.add(name, f"SELECT id, j + 1 AS i, {f} AS v FROM ({z})")


def history_select(losses: list[tuple[int, int, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {layer} AS layer, {epoch} AS epoch, {rounded('loss')} AS loss, m FROM {j}"
        for layer, epoch, j in losses
    )


def weights_select(finals: list[tuple[str, str]], digits: int = 6) -> str:
    parts = []
    for layer, (w, s) in enumerate(finals, 1):
        for role, t in (("encoder", w), ("decoder", s)):
            parts.append(
                f"SELECT {layer} AS layer, '{role}' AS role, i AS row, j AS col, "
                f"{rounded('w', digits)} AS w FROM {t}"
            )
    return " UNION ALL ".join(parts)
