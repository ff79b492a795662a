"""Quote verification and text anchoring as Spark plans."""
