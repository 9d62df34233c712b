"""driftline: trips, incidents and cell metrics of moving objects, as Spark plans."""
