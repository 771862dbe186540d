"""Small NumPy helpers that run inside Arrow tasks.

Each function here returns a closure that holds everything it needs, so
executors do not have to import this package.
"""

from __future__ import annotations

SPARSE = ("term_ids", "weights")
DENSE = ("vector",)
CHUNK_ROWS = 128
#: A term that one in so many rows has is common: its products are a matrix product.
COMMON_ROWS = 32
#: Rows of a product in single precision.
FILTER_ROWS = 256
#: Entries of the table in which pairs are scored exactly, and pairs that are scored at a time.
SCRATCH = 1 << 22
EXACT_PAIRS = 1 << 14


def vector_columns(vectors) -> tuple[str, ...]:
    """Which representation a vector table has."""
    return DENSE if "vector" in vectors.columns else SPARSE


def unit_matrix():
    """A function from an Arrow table with ``vector`` to unit-length rows; zero rows stay zero.

    A missing vector, one of another width and one with NULL or NaN entries are errors.
    """

    def read(table):
        import numpy as np

        n = table.num_rows
        lists = table.column("vector").combine_chunks()
        flat = lists.flatten()
        widths = np.diff(lists.offsets.to_numpy())
        if lists.null_count or flat.null_count or (n and (widths != widths[0]).any()):
            raise ValueError("vectors must have one width and no NULL")
        x = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
        if np.isnan(x).any():
            raise ValueError("vectors must not hold NaN")
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    return read


def rounder(digits: int):
    """Round halves away from zero, as Spark and SQL do."""

    def rounded(x):
        import numpy as np

        scale = 10.0**digits
        return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x) + 0.0

    return rounded


def row_scorer(sparse: bool, digits: int | None, chunk_rows: int | None = None):
    """A generator of similarities of some rows of a table to others, rounded unless ``digits`` is None.

    ``score(table, left, right)`` yields ``(rows, sims)`` for a few rows of
    ``left`` at a time against all of ``right``, so memory stays at a chunk
    times one block.  Dense rows are one matrix product.  Sparse rows are
    matched through the other side's entries sorted by term, so the work is
    the number of shared terms and no matrix as wide as the vocabulary exists;
    the terms that one in COMMON_ROWS of the other side has are a matrix product.
    """
    step, common_rows = chunk_rows or CHUNK_ROWS, COMMON_ROWS
    read, rounded = unit_matrix(), rounder(digits) if digits is not None else lambda x: x

    def dense(table, left, right):
        x = read(table)
        other = x[right].T
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            yield rows, rounded(x[rows] @ other)

    def entries(table, rows):
        import numpy as np

        part = table.take(rows)
        ids = part.column("term_ids").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy())
        weights = part.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(rows)), lengths), ids.flatten().to_numpy(zero_copy_only=False), weights

    def matched(table, left, right):
        import numpy as np

        r_row, r_term, r_weight = entries(table, right)
        order = np.argsort(r_term, kind="stable")
        r_row, r_term, r_weight = r_row[order], r_term[order], r_weight[order]
        n = len(right)
        known, first, count = np.unique(r_term, return_index=True, return_counts=True)
        common = known[count > n / common_rows] if n > common_rows else known[:0]
        often = np.zeros((max(len(common), 1), n))
        column, hit = placed(common, r_term)
        np.add.at(often, (column[hit], r_row[hit]), r_weight[hit])
        # The entries of all other terms, each term with its range.
        r_row, r_weight, r_term = r_row[~hit], r_weight[~hit], r_term[~hit]
        known, first, count = np.unique(r_term, return_index=True, return_counts=True)
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            l_row, l_term, l_weight = entries(table, rows)
            column, hit = placed(common, l_term)
            own = np.zeros((len(rows), len(often)))
            np.add.at(own, (l_row[hit], column[hit]), l_weight[hit])
            sims = own @ often
            column, hit = placed(known, l_term)
            if hit.any():
                l_row, l_weight, column = l_row[hit], l_weight[hit], column[hit]
                hits = count[column]
                before = np.cumsum(hits) - hits
                where = np.arange(hits.sum()) + np.repeat(first[column] - before, hits)
                cell = np.repeat(l_row * n, hits) + r_row[where]
                value = np.repeat(l_weight, hits) * r_weight[where]
                sims += np.bincount(cell, weights=value, minlength=len(rows) * n).reshape(len(rows), n)
            yield rows, rounded(sims)

    def placed(known, terms):
        """Where each term stands among the known ones, and which are known."""
        import numpy as np

        if not len(known):
            return np.zeros(len(terms), "int64"), np.zeros(len(terms), bool)
        column = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        return column, known[column] == terms

    return matched if sparse else dense


def pair_filter(sparse: bool):
    """Pairs of rows that reach a floor: ``prepare(table)``, to be called once, and ``near`` over what it returns.

    ``near(rows, left, right, floors, keep, slack)`` yields for a few rows of ``left``, which ascend, the row numbers of
    both sides and the scores, not rounded, of all pairs with rows of ``right`` that reach the floor of the left one;
    where many do, those that are more than ``slack`` behind the ``keep`` best of a row, or with ``across`` of all
    rows together, may be left out, and so may sparse pairs without a common term.  ``floors`` is read anew for
    each yield.  Sparse rows meet in single precision first; pairs that reach their floor within its error are
    scored in double precision, so none is lost and no score differs.
    """
    step, common_rows, scratch_cells, most = FILTER_ROWS, COMMON_ROWS, SCRATCH, EXACT_PAIRS
    read = unit_matrix()

    def prepare(table):
        import numpy as np

        if not sparse:
            return read(table)
        lists, weights = (table.column(c).combine_chunks() for c in ("term_ids", "weights"))
        starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
        first = starts[0] if len(starts) else 0
        coded = lists.flatten().dictionary_encode()
        weight = weights.flatten().to_numpy(zero_copy_only=False)
        width = max(len(coded.dictionary), 1)
        length = ends - starts
        norm = np.sqrt(np.bincount(np.repeat(np.arange(len(starts)), length), weight * weight, minlength=len(starts)))
        scratch = np.zeros((max(1, scratch_cells // width), width))
        return starts.astype("int64") - first, length, coded.indices.to_numpy(), weight, norm, scratch

    def entries(rows, some):
        """The entries of some rows: place of the row, term and weight."""
        import numpy as np

        starts, length, term, weight, *_ = rows
        n = length[some]
        at = np.arange(n.sum()) + np.repeat(starts[some] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(some)), n), term[at], weight[at]

    def exact(rows, a, b):
        """Scores of the pairs of rows ``a``, in ascending order, and ``b``."""
        import numpy as np

        scratch, out, at = rows[-1], np.zeros(len(a)), 0
        while at < len(a):
            some, first = np.unique(a[at : at + most], return_index=True)
            end = at + (first[len(scratch)] if len(some) > len(scratch) else len(a[at : at + most]))
            some = some[: len(scratch)]
            row, term, weight = entries(rows, some)
            np.add.at(scratch.reshape(-1), row * scratch.shape[1] + term, weight)
            pair, other, value = entries(rows, b[at:end])
            place = np.searchsorted(some, a[at:end])
            out[at:end] = np.bincount(pair, scratch[place[pair], other] * value, minlength=end - at)
            scratch[row, term] = 0
            at = end
        return out

    def chosen(sims, ok, keep, across, slack):
        """Of many pairs that reach their floors, those that may be among the best."""
        import numpy as np

        if across and ok.sum() > 2 * keep:
            some = sims[ok]
            return ok & (sims >= np.partition(some, len(some) - keep)[len(some) - keep] - slack)
        n = sims.shape[1]
        if not across and n > keep and ok.sum() > 2 * keep * len(sims):
            last = np.partition(np.where(ok, sims, -np.inf), n - keep, axis=1)[:, n - keep]
            return ok & (sims >= (last - slack)[:, None])
        return ok

    def near_sparse(rows, left, right, floors, keep, slack, *, across=False, allowed=None):
        import numpy as np

        if not len(left) or not len(right):
            return
        length, norm, width = rows[1], rows[4], rows[-1].shape[1]
        r_row, r_term, r_weight = entries(rows, right)
        n, count = len(right), np.bincount(r_term, minlength=width)
        common = np.flatnonzero(count > n / common_rows)
        place = np.full(width, -1)
        place[common] = np.arange(len(common))
        hit = place[r_term] >= 0
        often = np.zeros((len(common), n), "float32")
        np.add.at(often.reshape(-1), place[r_term[hit]] * n + r_row[hit], r_weight[hit].astype("float32"))
        # The entries of all other terms, each term with its range.
        r_row, r_term, r_weight = r_row[~hit], r_term[~hit], r_weight[~hit]
        order = np.argsort(r_term, kind="stable")
        r_row, r_weight = r_row[order].astype("int32"), r_weight[order].astype("float32")
        count[common] = 0
        first = np.cumsum(count) - count
        longest, largest = length[right].max(), norm[right].max()
        for at in range(0, len(left), step):
            some = left[at : at + step]
            l_row, l_term, l_weight = entries(rows, some)
            column = place[l_term]
            hit = column >= 0
            own = np.zeros((len(some), len(common)), "float32")
            np.add.at(own.reshape(-1), l_row[hit] * len(common) + column[hit], l_weight[hit].astype("float32"))
            sims = own @ often
            hit = count[l_term] > 0
            if hit.any():
                l_row, l_term, l_weight = l_row[hit], l_term[hit], l_weight[hit]
                hits = count[l_term]
                small = "int32" if max(hits.sum(), sims.size) < 1 << 31 else "int64"  # most time goes into moving these
                shift = (first[l_term] - np.cumsum(hits) + hits).astype(small)
                where = np.arange(hits.sum(), dtype=small) + np.repeat(shift, hits)
                cell = np.repeat((l_row * n).astype(small), hits) + r_row[where]
                np.add.at(sims.reshape(-1), cell, np.repeat(l_weight.astype("float32"), hits) * r_weight[where])
            # A sum of m products errs by m roundings at most, of what the lengths allow.
            error = (min(longest, length[some].max()) + 16) * 2.0**-23 * largest * norm[some].max()
            least = np.nextafter((floors[some] - error).astype("float32"), np.float32(-np.inf))
            ok = sims >= np.maximum(least, np.finfo("float32").smallest_subnormal)[:, None]
            if allowed is not None:
                ok &= allowed(some, right)
            row, other = np.nonzero(chosen(sims, ok, keep, across, 2 * error + slack))
            yield some[row], right[other], exact(rows, some[row], right[other])

    def near_dense(x, left, right, floors, keep, slack, *, across=False, allowed=None):
        import numpy as np

        others = x[right].T
        for at in range(0, len(left), step):
            some = left[at : at + step]
            sims = x[some] @ others
            ok = sims >= floors[some][:, None]
            if allowed is not None:
                ok &= allowed(some, right)
            row, other = np.nonzero(chosen(sims, ok, keep, across, slack))
            yield some[row], right[other], sims[row, other]

    return prepare, near_sparse if sparse else near_dense


def best_columns(k: int):
    """Indices of the k largest entries of a row, ties to the lower column; NaN ranks below all."""

    def best(row):
        import numpy as np

        row = np.where(np.isnan(row), -np.inf, row)
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            near = np.flatnonzero(row >= floor)
        else:
            near = np.arange(len(row))
        return near[np.argsort(-row[near], kind="stable")][:k]

    return best
