from barline.queries import crosssection, fixtures, labelling, learning, reports, research, streams, tables, text, timeseries, trading  # noqa: F401
from barline.queries.registry import QUERIES, oracle

__all__ = ["QUERIES", "oracle"]
