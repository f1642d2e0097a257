from tidemark.sources.contracts import CONTRACTS, cast_to_contract  # noqa: F401
from tidemark.sources.tables import Tables, read_table  # noqa: F401
