"""Where op logs come from and where state goes."""
