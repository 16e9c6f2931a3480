"""Reading and writing manifests, annotations and inventories."""
