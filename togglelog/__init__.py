"""Analytics over start/stop ("toggle") event logs of device fleets, as Spark DataFrame operators."""
