"""CPU, memory and network figures."""


def cpu_percent(cpu: str, prev_cpu: str, system: str, prev_system: str, cpus: str) -> str:
    """Share of the system's CPU time between two samples, times the CPU count.

    Missing system counters count as 0 and a missing CPU count as 1; no system progress
    gives 0.
    """
    used = f"(double({cpu}) - double({prev_cpu}))"
    passed = f"(double(coalesce({system}, 0L)) - double(coalesce({prev_system}, 0L)))"
    share = f"try_divide({used}, {passed}) * double(coalesce({cpus}, 1L)) * 100D"
    return f"CASE WHEN {passed} > 0D THEN {share} ELSE 0D END"


def memory_percent(usage: str, limit: str) -> str:
    """Usage in percent of the limit; null where the limit is 0."""
    return f"try_divide(double(coalesce({usage}, 0L)), double(coalesce({limit}, 1L))) * 100D"


def network_total(networks: str, field: str) -> str:
    """Bytes over all interfaces of one sample; 0 when it lists none."""
    total = f"aggregate(map_values({networks}), 0L, (sum, net) -> sum + coalesce(net.{field}, 0L))"
    return f"coalesce({total}, 0L)"
