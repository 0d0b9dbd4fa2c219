"""Sub-package of sluiceway; see the README for its contents."""
