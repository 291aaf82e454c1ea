"""The order star every operator reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shopgauge.schema import STAR_KEYS, STAR_SCHEMAS


class Star:
    """Eight tables with the column names of ``schema.STAR_SCHEMAS``; id types are free.

    Keys: ``orders.order_id``, ``customers.customer_id``, ``products.product_id``, ``sellers.seller_id`` and
    ``category_translation.product_category_name`` are unique. ``customer_id`` names one ordering session; the
    person behind it is ``customer_unique_id``.

    A table may be given as a function, which is called when an operator first asks for the table.
    """

    customers: DataFrame
    orders: DataFrame
    sellers: DataFrame
    products: DataFrame
    category_translation: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(STAR_SCHEMAS):
            raise ValueError(f"a star has the tables {sorted(STAR_SCHEMAS)}, not {sorted(tables)}")
        self._sources = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in STAR_SCHEMAS:
            raise AttributeError(name)
        source = self._sources[name]
        table = source if isinstance(source, DataFrame) else source()
        setattr(self, name, table)
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAR_SCHEMAS}

    def require_unique_keys(self) -> None:
        """An error if a key that must be unique is repeated; counts and sums would include its rows twice.

        One aggregation by key of each keyed table; a single key is fetched from each.
        """
        for name, key in STAR_KEYS.items():
            keys = getattr(self, name).select(key).where(F.col(key).isNotNull())
            repeated = keys.groupBy(key).count().where("count > 1").head()
            if repeated:
                raise ValueError(f"{name}.{key} must be unique, but {repeated[0]!r} occurs {repeated[1]} times")

    def create_views(self) -> None:
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)
