"""Named queries of the library, one module per part of the operator inventory."""
