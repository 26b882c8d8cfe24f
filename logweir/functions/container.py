"""Container attributes."""

# Fixed value: the label that names a container's compose project.
PROJECT_LABEL = "com.docker.compose.project"
# Fixed value: the file name that log rows carry.
COMPOSE_FILE = "docker-compose.yml"


def stack_of(labels: str) -> str:
    """The stack a container is labelled with, or null."""
    return f"try_element_at({labels}, '{PROJECT_LABEL}')"


def strip_slashes(name: str) -> str:
    return f"ltrim('/', {name})"


def is_up(status: str) -> str:
    """Running as lists report it, in any case."""
    return f"contains(lower({status}), 'up')"


def is_collected(status: str) -> str:
    """Running as collection reads it: ``Up``, case-sensitive."""
    return f"contains({status}, 'Up')"
