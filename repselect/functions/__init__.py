"""Part of repselect."""
