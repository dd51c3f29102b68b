"""litspark: literature-review analytics expressed as Spark DataFrame plans.

Layout
------
sources/    readers and writers (parquet tables, delimited files, whole texts, JSON lines)
functions/  Column -> Column building blocks (cleaning, tokenising, labels, years)
operators/  DataFrame -> DataFrame operators (filters, joins, aggregates, windows,
            sampling, term weighting, vectors, evaluation)
ml/         Spark ML training, fold loops and batch scoring
plans/      the registered queries and their SQL oracles
streaming/  notes on (the absence of) streaming operators
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python functions of this package that run on executors (the pandas UDF
    and the mapInPandas scorer) are pickled with their code, so executors need
    no installed copy of the package."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pickler: fall back to --py-files
        pass


_ship_by_value()
