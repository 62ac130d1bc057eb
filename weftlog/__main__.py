from weftlog.cli import main

raise SystemExit(main())
