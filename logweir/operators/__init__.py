"""DataFrame-to-DataFrame operators over logs, containers, stacks, alerts and metrics."""
