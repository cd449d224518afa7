"""Every operator pattern as a query over the driver's tables, with equivalent SQL."""
