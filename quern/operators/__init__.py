"""Jobs over DataFrames: joins, routing, clustering, mixtures, preference data, packing, quality and metrics."""
