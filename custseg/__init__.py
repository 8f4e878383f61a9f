"""custseg: customer value (RFM) and behaviour analytics as Spark DataFrame operators.

Layers:

* ``sources``   - bind physical tables onto the logical star schema and check contracts.
* ``functions`` - column-level building blocks (exact rounding, labels, bands, day types).
* ``operators`` - DataFrame operators: customer metrics, distributed exact NTILE / rank
  selection, segments, personas, behavioural analyses.
* ``plans``     - the named analyses (query registry) and their DuckDB oracle SQL.
"""

from custseg.params import Params

__all__ = ["Params"]
