"""Rows of samples for tests."""

import itertools

from tidepane.sources.samples import rows_to_samples


def series_rows(metric, jobs, start, stop, step=15_000, value=lambda i, t: float(t), **labels):
    """(labels, ms, value) of each job at every step, times in order."""
    out = []
    for t in range(start, stop, step):
        for i, job in enumerate(jobs):
            out.append(({"__name__": metric, "job": job, **labels}, t, value(i, t)))
    return out


_arrivals = itertools.count(0, 1_000_000)


def batch(spark, rows):
    """A sample table whose arrivals come after those of all tables made before."""
    return rows_to_samples(spark, rows, next(_arrivals))


def vector(df, *names):
    """Label values -> value of a vector."""
    return {tuple(r["labels"].get(n) for n in names): r["value"] for r in df.collect()}
