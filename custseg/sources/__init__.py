"""Sources: the logical star schema, its contract, and bindings onto physical tables."""

from custseg.sources.tables import CONTRACT, Tables, bind_testdata, check_contract, load_tables

__all__ = ["CONTRACT", "Tables", "bind_testdata", "check_contract", "load_tables"]
