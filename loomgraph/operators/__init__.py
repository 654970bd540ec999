"""Graph operators on DataFrames: scans, hops, variable-length paths, reachability."""
