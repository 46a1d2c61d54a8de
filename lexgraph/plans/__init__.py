"""plans of the engine."""

# the queries register themselves, in one order whichever module is asked for first: Python workers import a query's
# functions by their module's name
from . import answers, corpus, exchange, families, laws, records, retrieval  # noqa: F401
