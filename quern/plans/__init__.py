"""Plans: the registry of benchmarks and what combines and scores their prediction files."""
