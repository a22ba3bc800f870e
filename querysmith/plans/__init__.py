"""Plans that combine operators: workloads, execution of stored queries, datasets, command line."""
