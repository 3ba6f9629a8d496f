"""The registered queries, one module per operator family."""

from opsloom.catalog.registry import SQL_TWINS, QUERIES  # noqa: F401
import importlib
import pkgutil

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")
