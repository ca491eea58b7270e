"""Part of the help-desk library: functions."""
